"""Row-order helpers that never gather a whole key group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` in a range partitioning by key and order, written once, with its ``_block``; several of the steps below may share it."""
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``prev_<column>``: the value in the row before, within ``keys`` by ``order``.

    Rows are range-partitioned by key and order, so a key with very many rows spreads over many
    blocks. The lag runs inside each block; the first row of a block takes its value from the last
    row of the key's block before, found among one summary row per block.
    """
    shared = "_block" in df.columns
    blocks = df if shared else in_blocks(df, keys, order)
    inside = Window.partitionBy("_block", *keys).orderBy(*order)
    value = F.struct(*columns)
    last = blocks.groupBy("_block", *keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).select(
        "_block", *keys, "_carry")
    joined = blocks.withColumn("_lag", F.lag(value).over(inside)).join(carried, ["_block", *keys], "left")
    previous = F.coalesce("_lag", "_carry")
    return joined.withColumns({f"prev_{c}": previous[c] for c in columns}).drop("_lag", "_carry", *(() if shared else ("_block",)))


def with_running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``sum_<column>``: the running sum up to and including the row, within ``keys`` by ``order``.

    Same block scheme: sums run inside a block and start from the total of the key's earlier blocks.
    """
    shared = "_block" in df.columns
    blocks = df if shared else in_blocks(df, keys, order)
    inside = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("_block", *keys).agg(*[F.sum(c).alias(c) for c in columns])
    base = totals.select("_block", *keys, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_base_{c}") for c in columns])
    return (blocks.join(base, ["_block", *keys])
            .withColumns({f"sum_{c}": F.sum(c).over(inside) + F.col(f"_base_{c}") for c in columns})
            .drop(*[f"_base_{c}" for c in columns], *(() if shared else ("_block",))))
