"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, a row's cell gets its index on the Hilbert curve, and the
rows in curve order are cut into runs of equal count. Neighbours on the curve are neighbours in every dimension, so a file
holds narrow ranges of all of them and a filter on any prunes files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import staged, table

SHARDS = 16
BITS = 8


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell with coordinates of ``bits`` bits each; the whole index must fit in 62 bits.

    The coordinates are folded level by level into the curve's frame, then Gray-coded and interleaved.
    """
    n = len(axes)
    cells = F.array(*[a.cast("long") for a in axes])
    steps = F.sequence(F.lit(0), F.lit(n * (bits - 1) - 1))
    power = lambda e: F.pow(F.lit(2.0), e).cast("long")  # noqa: E731  exact below 2**53

    def fold(x: Column, step: Column) -> Column:
        i = F.pmod(step, F.lit(n)).cast("int")
        level = power(F.lit(bits - 1) - F.floor(step / n))
        inverted = x[i].bitwiseAND(level) != 0
        swap = F.when(inverted, level - 1).otherwise(x[F.lit(0)].bitwiseXOR(x[i]).bitwiseAND(level - 1))
        return F.transform(x, lambda v, k: v.bitwiseXOR(
            F.when(k == 0, swap).when((k == i) & ~inverted, swap).otherwise(F.lit(0).cast("long"))))

    folded = F.aggregate(steps, cells, fold) if bits > 1 else cells
    gray = F.transform(folded, lambda v, k: F.aggregate(F.slice(folded, F.lit(1), k + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))
    levels = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>")
    flip = lambda g: F.aggregate(levels, F.lit(0).cast("long"), lambda t, q: t.bitwiseXOR(
        F.when(g[F.lit(n - 1)].bitwiseAND(power(q)) != 0, power(q) - 1).otherwise(F.lit(0).cast("long"))))
    turned = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(flip(g))))[F.lit(0)]
    places = F.sequence(F.lit(0), F.lit(n * bits - 1))
    return F.transform(F.array(turned), lambda g: F.aggregate(places, F.lit(0).cast("long"), lambda h, p: h * 2 + F.floor(
        g[F.pmod(p, F.lit(n)).cast("int")] / power(F.lit(bits - 1) - F.floor(p / n))).cast("long").bitwiseAND(F.lit(1).cast("long"))))[F.lit(0)]


def document_axes(bits: int = BITS) -> list[Column]:
    """Source, language and size of a document in ``bits`` bits each; null names count as empty, sizes go by their logarithm."""
    name = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << bits))
    return [name("source"), name("lang"), F.least(F.floor(F.log2(F.col("size").cast("double")) * 8), F.lit((1 << bits) - 1))]


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Places every row: doc_id, size, text_crc32, curve (its index), shard, slot (its place in the shard, from 0).

    The law is ``rows``: run i holds the ranks from ceil(i*n/shards), so counts differ by one at most. Rows of one cell are
    ordered by text hash and doc_id, repeated rows by their place in the input. Null texts are empty, null ids sort first,
    null sources and languages count as empty names; other columns are not read. With no rows there is no result.

    Only narrow rows are shuffled. The order is cut into ranges by a key that is unique, so that no cell, text or id,
    however frequent, lands in one task; ranks are counted inside a range and start from the counts of the ranges before.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), (F.octet_length(text).cast("long") + 1).alias("size"),
                         F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
                         F.monotonically_increasing_id().alias("row"))
    cells = staged(narrow.select("doc_id", "size", "text_crc32", "text_hash", "row", hilbert_index(document_axes(bits), bits).alias("curve")), "hilbert-cells")
    order = ["curve", "text_hash", "doc_id", "row"]
    blocks = staged(cells.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "hilbert-blocks")
    counts = blocks.groupBy("block").agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(
        Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1 + F.col("before")
    ranked = blocks.join(starts, "block").withColumn("rank", rank)
    at = F.expr(f"(rank * {shards}) div n").cast("int")
    placed = ranked.withColumn("shard", at)
    first = F.expr(f"(shard * n + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - first).alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes one folder per shard, rows in curve order, so that each file's statistics are narrow in all dimensions."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")
