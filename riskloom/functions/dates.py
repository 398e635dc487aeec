"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def elapsed_days(start: Column, end: Column) -> Column:
    """Fractional days between two timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end) / MICROS_PER_DAY


def day_component(start: Column, end: Column) -> Column:
    """Days left over after the whole calendar months between two timestamps.

    ``months_between`` is not used: it counts two month ends as a whole month.
    """
    clock = lambda ts: F.date_format(ts, "HH:mm:ss.SSSSSS")
    earlier_clock = F.when(clock(end) < clock(start), 1).otherwise(0)
    calendar_months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    short_month = (F.dayofmonth(end) < F.dayofmonth(start)) | (
        (F.dayofmonth(end) == F.dayofmonth(start)) & (earlier_clock == 1))
    months = calendar_months - F.when(short_month, 1).otherwise(0)
    return F.datediff(F.to_date(end), F.add_months(F.to_date(start), months)) - earlier_clock
