"""Benchmark decontamination by suffix arrays of the training text.

Each shard of documents becomes an array of word numbers. Its suffixes are sorted by prefix doubling, jointly with those of
the benchmark, and every benchmark suffix is looked up in that order by binary search. The suffixes found are the verbatim
matches of a window; runs of them are the longest matches, with their places.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import prepare, table

WINDOW = 10
#: Benchmark text that is searched in one pass and so sent to every executor; more text takes more passes.
PASS_BYTES = 16 << 20
_BITS = 22

# Bytes: A-Z become lower case, all that isn't a letter, a digit or beyond ASCII parts words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots of word pairs in a bitmap."""
    return (a * 0x9E3779B1 ^ b * 0x85EBCA77) & ((1 << _BITS) - 1)


class Benchmark:
    """Windows of the items of one pass."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        split = [(name, words(text)) for name, text in items]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}  # in order, so ranks are lexicographic
        self.names = [name for name, ws in split if ws]
        arrays, at = [], 0
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, ws in enumerate(ws for _, ws in split if ws):
            size = min(window, len(ws))
            starts[size].append(np.arange(at, at + len(ws) - size + 1))
            owners[size].append(np.full(len(ws) - size + 1, item))
            arrays += [np.array([self.number[w] for w in ws], np.int64), np.zeros(1, np.int64)]
            at += len(ws) + 1
        self.text = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        self.windows = {n: (np.concatenate(starts[n]), np.concatenate(owners[n])) for n in sorted(starts)}
        self.pairs = np.zeros(1 << _BITS, bool)
        if len(self.text) > 1:
            self.pairs[_pair(self.text[:-1], self.text[1:])] = True

    def search(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and item of every verbatim window in a shard of word numbers (0: other words and ends of texts)."""
        empty = np.zeros(0, np.int64)
        if not self.windows or not len(shard):
            return empty, empty, empty
        least = min(self.windows)
        # Only runs of at least ``least`` words whose neighbours are neighbours in the benchmark can hold a window.
        follows = np.zeros(len(shard), bool)
        follows[1:] = (shard[1:] > 0) & (shard[:-1] > 0) & self.pairs[_pair(shard[:-1], shard[1:])]
        run = np.cumsum((shard > 0) & ~follows)
        size = np.bincount(run[shard > 0], minlength=int(run[-1]) + 1)
        kept = np.flatnonzero((shard > 0) & (size[run] >= least))
        if not len(kept):
            return empty, empty, empty
        ends = np.flatnonzero(np.diff(run[kept])) + 1
        place = np.insert(kept, ends, -1)  # -1: between two runs
        part = np.where(place >= 0, shard[place], 0)
        text = np.concatenate([self.text, part, np.zeros(1, np.int64)])
        base, out = len(self.text), []
        ranks, depth = text, 1
        for n in sorted(self.windows):
            while depth * 2 <= n:
                ranks, depth = _doubled(ranks, depth), depth * 2
            order_key = ranks * (int(ranks.max()) + 1) + _shifted(ranks, n - depth) if n > depth else ranks
            mine = np.flatnonzero(part > 0)
            keys = order_key[base + mine]
            suffixes = np.argsort(keys, kind="stable")  # the suffix array of the shard, to depth n
            ordered = keys[suffixes]
            starts, owners = self.windows[n]
            tests = order_key[starts]
            tests, owners = np.unique(np.stack([tests, owners]), axis=1)  # equal windows of one item give each match once
            low, high = np.searchsorted(ordered, tests, "left"), np.searchsorted(ordered, tests, "right")
            count = high - low
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = place[mine[suffixes[np.repeat(low, count) + offset]]]
            out.append((found, np.full(len(found), n), np.repeat(owners, count)))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([ranks[by:], np.zeros(by, ranks.dtype)])


def _doubled(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of prefixes twice as long. What lies between texts has ranks of its own, which no window of an item contains."""
    key = ranks * (int(ranks.max()) + 1) + _shifted(ranks, depth)
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


_FOUND = "struct<n_words:bigint,spans:array<struct<start:int,length:int>>,items:array<string>>"


def _pass(bench: Benchmark, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Per text: words, places of hit words, names of items."""
    split = [words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    shard = np.zeros(int((counts + 1).sum()), np.int64)
    get = bench.number.get
    for start, ws in zip(starts, split, strict=True):
        shard[start:start + len(ws)] = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
    place, size, item = bench.search(shard)
    edge = np.zeros(len(shard) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + size, -1)
    hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    hits = np.split(hit, np.searchsorted(hit, starts[1:])) if len(starts) else []
    names: list[list[str]] = [[] for _ in texts]
    owner = np.searchsorted(starts, place, "right") - 1
    for doc, i in np.unique(np.stack([owner, item]), axis=1).T.tolist() if len(place) else []:
        names[doc].append(bench.names[i])
    return counts, [h - s for h, s in zip(hits, starts, strict=True)], names


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Each row of ``docs`` as ``row``, and ``found``: n_words, spans (longest runs of hit words), items (sorted names).

    A window is ``window`` words in sequence of an item, or the whole of a shorter item that has words. Null texts have no
    words; repeated rows are rows of their own; columns of any name stay inside ``row``. An empty benchmark finds nothing.
    Items of one name count as one. Documents are not shuffled; the benchmark is sent in passes of bounded size.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / pass_bytes))
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    out = docs.select(F.struct(*docs.columns).alias("row"), F.lit(None).cast(_FOUND).alias("found"))
    for i in range(passes):
        # At most one pass of the benchmark, of pass_bytes about, reaches the driver at a time.
        bench = spark.sparkContext.broadcast([(r[0] or "", r[1]) for r in items.where(at == i).collect()])
        out = out.mapInArrow(_marker(bench, window), out.schema)
    return out


_indexes: dict[str, Benchmark] = {}  # of this worker, by pass


def _marker(shared, window: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Benchmark(shared.value, window)
        bench = _indexes[name]
        for batch in batches:
            rows = batch.column("row")
            counts, hits, names = _pass(bench, rows.field("text").cast(pa.string()).to_pylist())
            before = batch.column("found").to_pylist()
            found = []
            for n, hit, new, old in zip(counts.tolist(), hits, names, before, strict=True):
                if old and old["spans"]:
                    hit = np.union1d(hit, np.concatenate([np.arange(s["start"], s["start"] + s["length"]) for s in old["spans"]]))
                cuts = np.flatnonzero(np.diff(hit) > 1) + 1
                spans = [{"start": int(h[0]), "length": len(h)} for h in np.split(hit, cuts) if len(h)]
                found.append({"n_words": n, "spans": spans, "items": sorted({*new, *(old["items"] if old else ())})})
            kind = batch.schema.field("found").type
            yield pa.RecordBatch.from_arrays([rows, pa.array(found, kind)], schema=batch.schema)
    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    return find(docs, benchmark, window).where(F.size("found.items") == 0).select("row.*")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("row.doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "found.items").cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of the benchmark go."""
    prepare(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), sized AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, n, unnest(range(1, (len(ws) - n + 2)::BIGINT)) AS i FROM sized)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1)::BIGINT)) AS i FROM w, lens)
), m AS (SELECT d.doc_id, d.i, d.n, bw.item_id FROM dw d JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT w.doc_id, coalesce(len(w.ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
