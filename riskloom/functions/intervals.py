"""Joins of ranges that overlap, as equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    first, last = (F.floor(c / width).cast("bigint") for c in (start, end))
    return F.explode(F.when(start <= end, F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str],
                width: int) -> DataFrame:
    """Pairs with equal ``on`` columns whose closed ranges of whole numbers meet.

    Ranges are cut into bins of ``width``. Rows meet by key and bin, so a key with many ranges is spread over its bins and
    never paired with itself as a whole; a pair is kept in its first common bin only. A ``width`` near the usual length of
    a range cuts each into a few bins. Empty ranges (end before start) and null ends meet nothing. Columns other than
    ``on`` must have different names on the two sides.
    """
    (a, b), (c, d) = ([F.col(x) for x in pair] for pair in (left_range, right_range))
    pairs = left.withColumn("_bin", _bins(a, b, width)).join(right.withColumn("_bin", _bins(c, d, width)), [*on, "_bin"])
    first = F.floor(F.greatest(a, c) / width).cast("bigint")
    return pairs.filter((a <= d) & (c <= b) & (F.col("_bin") == first)).drop("_bin")
