"""Text expressions shared by the segmenters and chunkers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TokenCounter = Callable[[Column], Column]
SENTENCE_END = r"(?<=[.!?])\s+"
WHITE_SPACE = " \t\r\n\f\u000b\u00a0\ufeff"


def estimate_tokens(text: Column) -> Column:
    """A quarter token per character, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Like ``withColumns``, but the values are fixed before later expressions read them.

    The optimizer merges stacked projections and would move an expression into a lambda that runs
    it once per array element; an inline of a single struct keeps it where it is.
    """
    value = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(value)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def join_lines(lines: Column, start: Column, count: Column) -> Column:
    """``count`` lines from the 0-based ``start``, joined by line breaks."""
    return F.array_join(F.slice(lines, start + 1, F.greatest(count, F.lit(0))), "\n")


def capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first keyword, in list order, that occurs in the lower-cased text; null if none."""
    listed = F.array(*[F.lit(k) for k in keywords])
    return let(F.lower(text), lambda low: F.get(F.filter(listed, lambda k: F.contains(low, k)), F.lit(0)))


def any_of(keywords: Sequence[str]) -> str:
    """Regular expression for any of the (letter-only) keywords."""
    return "(?:" + "|".join(keywords) + ")"


def last_match(lines: Column, pattern: str, default: str) -> Column:
    """Group 1 of ``pattern`` on the last matching line, stripped; ``default`` if no line matches."""
    hits = F.filter(lines, lambda line: F.rlike(line, F.lit(pattern)))
    found = let(F.get(F.reverse(hits), F.lit(0)), lambda line: strip(F.regexp_extract(line, pattern, 1)))
    return F.coalesce(found, F.lit(default))


def line_of(text: Column, position: Column) -> Column:
    """1-based line number of a 0-based character position."""
    return F.size(F.split(F.substring(text, F.lit(1), position), "\n", -1))


def locate_lines(text: Column, part: Column) -> Column:
    """struct(line_start, line_end) of the first occurrence of ``part``; null if it does not occur."""
    return let(F.position(part, text), lambda at: F.when(at > 0, F.struct(
        line_of(text, at - 1).alias("line_start"),
        line_of(text, at - 1 + F.length(part)).alias("line_end"))))


def split_points(flags: Column) -> Column:
    """0-based positions of the true entries of a boolean array."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
