"""Near duplicates by SimHash, with candidates filtered by the pigeonring principle.

Cut 64 bits into m segments on a ring. If two fingerprints differ in at most t bits, there is a segment from which every
chain of l consecutive segments differs in at most l*t/m bits. For t = 2 and m = 7 this means: three segments in sequence
are equal, chains of four to six differ in one bit at most. The three equal segments are the key of a bucket; the longer
chains prune inside it, before the full count of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import components, staged, table, texts

WORDS, SEED = 3, 42
DISTANCE, SEGMENTS = 2, 7
#: Fingerprints of a bucket that are compared one by one; those of larger buckets are linked through points between them.
COMPARED = 128

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str) -> int:
    """SimHash of a whole text as a signed 64-bit number."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``fp``. Null and empty texts, and texts without words, have fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            found = pa.array([fingerprint(t) for t in texts(rows.field("text").cast(pa.string()))], pa.int64())
            yield pa.RecordBatch.from_arrays([rows, found], schema=batch.schema)

    packed = docs.select(F.struct(*docs.columns).alias("row"), F.lit(0).cast("long").alias("fp"))
    return packed.mapInArrow(run, packed.schema)


def _masks(length: int, segments: int = SEGMENTS) -> list[int]:
    """Bits of the ``length`` segments from each start on, as signed numbers."""
    ends = [64 * i // segments for i in range(segments + 1)]
    part = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(segments)]
    bits = [sum(part[(start + j) % segments] for j in range(length)) for start in range(segments)]
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within ``distance`` (2) bits, by one path at least.

    Buckets of up to COMPARED members are joined with themselves under the chain test. In larger ones, as a large group of
    near copies makes them, each fingerprint stands for itself and its 64 neighbours at one bit: two lie within two bits if
    and only if they share such a point, so all that share one are linked to the least of them. That is 65 rows for each
    fingerprint however many share a bucket, and it loses no link.
    """
    if distance != 2:
        raise ValueError("the points between fingerprints are those for two bits")
    equal = next(n for n in range(segments, 0, -1) if n * distance < segments)  # chains that may not differ at all
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(equal, segments))])).alias("at")
    keyed = staged(prints.select("fp").distinct().select("fp", key).select("fp", "at.start", "at.key"), "simhash-keys")
    sizes = keyed.groupBy("start", "key").count().where("count > 1")
    some = sizes.where(F.col("count") <= COMPARED).select("start", "key")
    shared = keyed.join(some, ["start", "key"])
    a, b = shared.withColumnRenamed("fp", "a"), shared.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    of = lambda n: F.element_at(F.array(*[F.lit(m) for m in _masks(n, segments)]), F.col("l.start") + 1)
    chains = F.lit(True)
    for n in range(equal + 1, segments):
        chains &= F.bit_count(differ.bitwiseAND(of(n))) <= n * distance // segments
    near: Column = (F.col("a") < F.col("b")) & chains & (F.bit_count(differ) <= distance)
    compared = a.alias("l").join(b.alias("r"), (F.col("l.start") == F.col("r.start")) & (F.col("l.key") == F.col("r.key")) & near).select("a", "b")

    crowded = keyed.join(sizes.where(F.col("count") > COMPARED).select("start", "key"), ["start", "key"], "left_semi").select("fp").distinct()
    flips = F.array(*[F.lit(_signed(1 << i)) for i in range(64)], F.lit(0).cast("long"))
    points = crowded.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a <> top").select("point", "a")
    return compared.union(points.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b"))).distinct()


def grouped(prints: DataFrame, name: str = "simhash") -> DataFrame:
    """fp and root, the least fingerprint it can be reached from, for fingerprints that have a link."""
    return components(links(prints), name).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links. A null id is no smallest id, so a group of
    such rows alone has none; repeated rows stay repeated; an empty table gives no rows."""
    prints = staged(with_fingerprints(docs.select(F.col("doc_id").cast("long"), "text")).select("row.doc_id", "fp"), "simhash-prints")
    roots = grouped(prints)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(firsts.join(smallest, "root").select("fp", "component_id"), "fp")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id (null ids last), then the first in the input."""
    held = staged(with_fingerprints(docs).withColumn("place", F.monotonically_increasing_id()), "simhash-rows")
    prints = held.select("fp", F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), "place").alias("rank"))
    best = prints.groupBy("fp").agg(F.min("rank").alias("rank"))
    roots = best.join(grouped(prints), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "rank")
    kept = roots.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.place").alias("place"))
    return held.join(kept, "place", "left_semi").select("row.*")


def op6_simhash_components(spark, sf_dir: str) -> DataFrame:
    found = component_ids(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
