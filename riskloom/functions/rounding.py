"""Rounding as the reports show it: half up, not half even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, places: int) -> Column:
    scale = float(10 ** places)
    return F.floor(value * scale + 0.5) / scale


def ratio(part: Column, whole: Column, scale: float = 1.0, empty: float = 0.0) -> Column:
    """``scale * part / whole``, or ``empty`` when the denominator is zero or missing."""
    return F.when(whole > 0, part * scale / whole).otherwise(F.lit(empty))


def percentage(part: Column, whole: Column) -> Column:
    return round_half_up(ratio(part, whole, 100.0), 2)
