"""Quality classifier learned from trusted positives and unlabelled text.

Risk of a scorer g from positives P, unlabelled texts U and the share pi of positives, after Kiryo et al. (2017):
pi * R_P(g, +) + max(0, R_U(g, -) - pi * R_P(g, -)). The second term estimates the risk on the negatives, which cannot be
below zero; where it falls below, the step goes against it. Negative labels take no part in the risk; with the positive
ones they give the estimate of pi.

The scorer adds one weight per feature and quantile bin, so it is free in each feature and reads whole texts only by counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskloom.llm.common import prepare, table, texts

#: Bounds of the fitting sample: labelled rows, and unlabelled texts. Those with the smallest id hashes are taken.
LABELLED, UNLABELLED = 12_000, 12_000
FOLDS, HELD_OUT = 3, 1
BINS, STEPS, RATE, DECAY = 16, 600, 0.05, 1e-3

_CLASSES = np.zeros((256, 8))
for _i, _c in enumerate(map(chr, range(128))):
    _CLASSES[_i, 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in " " else 4 if _c in "\n\r\t" else 5 if _c in ".,;:?'\"-()" else 6] = 1
_CLASSES[128:, 7] = 1
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()")


def features(text: str) -> list[float]:
    """Counts over the whole text, as shares or logarithms."""
    data = text.encode()
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    k = max(1, len(words))
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    shares = (counts @ _CLASSES) / n
    stops = counts[[46, 33, 63]].sum()
    spread = counts[counts > 0] / n
    return [*shares, np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), float(sizes.max()), distinct / k, np.log1p(distinct) / np.log1p(k),
            len(set(lines)) / len(lines), n / len(lines), stops / k, counts.max() / n, counts[list(_SYMBOL)].max() / k, float(-(spread * np.log(spread)).sum()),
            len(set(zip(words, words[1:]))) / k, sum(map(bytes.isupper, words)) / k]


N_FEATURES = len(features(""))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % FOLDS == HELD_OUT


class Scorer:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.edges, self.weights, self.bias = edges, weights, bias

    @staticmethod
    def binned(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Column of each value's bin in the one-hot matrix."""
        bins = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)
        return bins + np.arange(len(edges)) * BINS

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[self.binned(self.edges, x)].sum(1) + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Scorer:
    """Minimises the non-negative risk by Adam over all given rows; without positives everything scores 0.5."""
    both = np.concatenate([positive, unlabelled])
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros((N_FEATURES, BINS - 1)), np.zeros(N_FEATURES * BINS), 0.0)
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    p, u = Scorer.binned(edges, positive), Scorer.binned(edges, unlabelled)
    w, bias = np.zeros(N_FEATURES * BINS), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def pull(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Gradient of a mean over rows: slopes summed per weight."""
        out = np.bincount(rows.ravel(), np.repeat(slope / len(rows), rows.shape[1]), len(w))
        return np.append(out, slope.mean())

    for step in range(1, STEPS + 1):
        gp, gu = w[p].sum(1) + bias, w[u].sum(1) + bias
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        # Sigmoid loss: l(g, +) = 1 - s(g), l(g, -) = s(g).
        negative = su.mean() - prior * sp.mean()
        down = pull(u, su * (1 - su)) - prior * pull(p, sp * (1 - sp))
        grad = -prior * pull(p, sp * (1 - sp)) + down if negative >= 0 else -down
        grad[:-1] += DECAY * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        move = RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Scorer(edges, w, bias)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([np.array(features(t)).tobytes() for t in texts(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([rows], ["x"])


def _collected(rows: DataFrame, most: int) -> np.ndarray:
    """Features of a sample that was chosen to be small; the limit guards against ids that repeat."""
    found = rows.select(F.col("text").cast("string")).mapInArrow(_features, "x binary").limit(2 * most).collect()
    return np.frombuffer(b"".join(r.x for r in found)).reshape(-1, N_FEATURES)


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fits the scorer on at most LABELLED labels and about UNLABELLED texts, both outside the held-out fold.

    Of an id with contradicting labels none is used; null ids and labels are not used. The prior is the share of positives
    among the labels of the sample. Without labels the scorer says 0.5.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = (labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality is not null")
             .where(fold != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
             .where("quality = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select("doc_id", "quality"))
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    plain = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull() & (fold != HELD_OUT))
    n = plain.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, UNLABELLED / max(n, 1))))
    # At most LABELLED ids are sent to the executors.
    positive = _collected(plain.join(F.broadcast(known.where("quality = 1")), "doc_id", "left_semi"), LABELLED)
    return fit(positive, _collected(plain.where(drawn), UNLABELLED), share or 0.0)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Each row of ``docs`` as ``row`` and its ``score`` between 0 and 1.

    Only the text is an input; a null text counts as empty and has a score too. Repeated rows stay repeated, equal texts
    have equal scores, columns of any name stay inside ``row``. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            x = np.array([features(t) for t in texts(rows.field("text").cast(pa.string()))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([rows, pa.array(shared.value(x))], schema=schema(batch))

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        return batch.schema.append(pa.field("score", pa.float64()))

    packed = docs.select(F.struct(*docs.columns).alias("row"))
    return packed.mapInArrow(run, StructType([*packed.schema.fields, StructField("score", DoubleType())]))


def op2_pu_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    out = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    fold = F.pmod(F.crc32(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return out.select("row.doc_id", (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    prepare(spark)
    return scored(docs, learn(docs, table(spark, sf_dir, "labels"))).where("score >= 0.5").select("row.*")
