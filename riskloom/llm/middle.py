"""Fill-in-middle over a learned rank index.

The boundaries between the tokens of a text, by rank, lie near a few straight lines. The index keeps the lines (segments
with a bound on their error) and, for each boundary, how far the line is off. A cut at any rank is predicted by its line and
corrected exactly by what is stored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import table, texts

#: Greatest error of a segment, so that a residual fits in one byte.
ERROR = 120
#: Code points that are looked at together.
CHUNK = 1 << 20
SENTINELS = ("<P>", "<S>", "<M>")


class RankIndex:
    """Rising offsets by rank: ``index[k]`` is the k-th, ``len(index)`` how many there are.

    Segments grow while some line through their first point stays within ``error`` of all their points; the range of slopes
    that do so narrows from point to point and a segment ends where it is empty.
    """

    def __init__(self, error: int = ERROR) -> None:
        if not 0 < error <= ERROR:
            raise ValueError(f"the error must be 1 to {ERROR}")
        self.error = error
        self.ranks: list[int] = []
        self.starts: list[int] = []
        self.slopes: list[float] = []
        self.residuals = bytearray()

    def __len__(self) -> int:
        return len(self.residuals)

    def extend(self, offsets: np.ndarray) -> None:
        """Appends offsets, in order and all above those before."""
        at, width = 0, 1 << 11
        while at < len(offsets):
            rise = (offsets[at + 1:at + width] - offsets[at]).astype(np.float64)
            steps = np.arange(1, len(rise) + 1, dtype=np.float64)
            least = np.maximum.accumulate((rise - self.error) / steps)
            most = np.minimum.accumulate((rise + self.error) / steps)
            fits = len(rise) if not len(rise) or least[-1] <= most[-1] else int(np.argmax(least > most))
            if fits == len(rise) and at + width < len(offsets):
                width *= 2
                continue
            slope = (least[fits - 1] + most[fits - 1]) / 2 if fits else 0.0
            off = rise[:fits] - np.floor(steps[:fits] * slope)
            self.ranks.append(len(self.residuals))
            self.starts.append(int(offsets[at]))
            self.slopes.append(float(slope))
            self.residuals += b"\0" + off.astype(np.int8).tobytes()
            at, width = at + 1 + fits, 1 << 11

    def predicted(self, rank: int) -> int:
        """Offset by the line alone."""
        k = bisect_right(self.ranks, rank) - 1
        return self.starts[k] + int(np.floor(np.float64(rank - self.ranks[k]) * self.slopes[k]))

    def __getitem__(self, rank: int) -> int:
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        byte = self.residuals[rank]
        return self.predicted(rank) + (byte - 256 if byte > 127 else byte)


def boundaries(text: str, error: int = ERROR, chunk: int = CHUNK) -> RankIndex:
    """Index of the boundaries of ``text``: token k (a run of letters A-Z, a-z, or any other code point) is [k], [k + 1]."""
    index, letter_before = RankIndex(error), False
    for at in range(0, len(text), chunk):
        points = np.frombuffer(text[at:at + chunk].encode("utf-32-le"), np.uint32)
        letter = np.concatenate(([letter_before], ((points | 32) - np.uint32(97)) < 26))
        index.extend(at + np.flatnonzero(~(letter[1:] & letter[:-1])))
        letter_before = bool(letter[-1])
    index.extend(np.array([len(text)]))
    return index


def transform(docs: DataFrame, plain_above: int = 90, suffix_first_below: int = 20, seed: str = "1") -> DataFrame:
    """Rewrites each text for fill-in-middle: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    Cuts, and the choice of a form, come from the hash of seed and doc_id. ``plain`` keeps the text (empty, holding a
    sentinel, or left out by the hash); ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, each after its
    sentinel. Null texts are empty, a null id hashes as an empty name, repeated rows come out alike, other columns are not
    read. Whole texts, row by row without a shuffle; a text's index takes about a byte a token.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    p, s, m = SENTINELS

    def cut(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        index = boundaries(text)
        n = len(index) - 1
        if not text or h3 % 100 >= plain_above or any(x in text for x in SENTINELS):
            return n, "plain", None, None, text
        low, high = sorted((index[h1 % (n + 1)], index[h2 % (n + 1)]))
        prefix, middle, suffix = text[:low], text[low:high], text[high:]
        spm = h4 % 100 < suffix_first_below
        return n, "spm" if spm else "psm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"

    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(*row) for row in zip(texts(batch.column("text")), *(batch.column(f"h{k}").to_pylist() for k in range(1, 5)))]
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *schema.names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *hashes).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with sentinels are plain, so the three sentinels split exactly."""
    part = lambda k: F.split(output, "|".join(SENTINELS), -1)[k]
    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
            .when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH tokens AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
           sha256('1:' || doc_id) AS h
    FROM documents),
drawn AS (
    SELECT doc_id, text, t, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
           ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
    FROM tokens),
cut AS (
    SELECT *, array_to_string(t[1:least(a, b)], '') AS prefix, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS middle,
           array_to_string(t[greatest(a, b) + 1:n], '') AS suffix,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
                WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
