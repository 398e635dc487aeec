"""Periodic runs of words by recompression.

A grammar of the words is built level by level: stretches of one symbol become a symbol, then pairs of a left and a right
symbol do, by turns, until each text is one symbol. Equal stretches of words are parsed alike but for their ends, so the
grammar answers how far two places agree (longest common extension) in a few steps a level. A run of period q and length
4 q or more must hold a word of the grid of stride 3 q, so the grid points of all periods, n log n of them in a text of n
words, are all places where a run need be looked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import table

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Words of a text up to which the grid is kept between texts, and grid points of a longer text that are looked at together.
GRID_WORDS, GRID_POINTS = 1 << 18, 1 << 21
#: Levels without any change after which the grammar is taken as complete.
STILL = 16
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Level(NamedTuple):
    """Symbols of one level; ``up`` is each one's place in the next, ``first`` and ``last`` each next one's ends in this."""

    symbols: np.ndarray
    blocks: bool
    up: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Grammar:
    """Run-length grammar of ``codes``. Codes below ``fences`` occur once each, join with nothing and stand at both ends."""

    def __init__(self, codes: np.ndarray, fences: int) -> None:
        symbols, free, still, turn = codes.astype(np.int64), int(codes.max(initial=0)) + 1, 0, 0
        self.levels: list[Level] = []
        while still < STILL and len(symbols) >= 2 * fences:
            blocks = turn % 2 == 0
            starts = self._block_starts(symbols) if blocks else self._pair_starts(symbols, fences, turn)
            turn += 1
            if len(starts) == len(symbols):
                still += 1
                continue
            still = 0
            ends = np.append(starts[1:], len(symbols))
            joined = np.flatnonzero(ends - starts > 1)
            # What a new symbol stands for: a block's symbol and length, or the two symbols of a pair.
            with_what = (ends - starts)[joined] if blocks else symbols[starts[joined] + 1]
            kinds, name = np.unique((symbols[starts[joined]] << 31) | with_what, return_inverse=True)
            upper = symbols[starts]
            upper[joined] = free + name
            free += len(kinds)
            up = np.zeros(len(symbols), np.int32)
            up[starts[1:]] = 1
            self.levels.append(Level(symbols, blocks, np.cumsum(up, dtype=np.int32), starts.astype(np.int32), (ends - 1).astype(np.int32)))
            symbols = upper
        self.top = symbols

    @staticmethod
    def _block_starts(symbols: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))

    @staticmethod
    def _pair_starts(symbols: np.ndarray, fences: int, turn: int) -> np.ndarray:
        """A symbol is left or right by a bit of its hash, another one each turn; of both ways round the one with more pairs."""
        mixed = (symbols.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        bit = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)) & np.uint64(1)
        left, right = (symbols >= fences) & (bit == 1), (symbols >= fences) & (bit == 0)
        second = max((np.flatnonzero(a[:-1] & b[1:]) + 1 for a, b in ((left, right), (right, left))), key=len)
        begins = np.ones(len(symbols), bool)
        begins[second] = False
        return np.flatnonzero(begins)

    def extent(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from each pair of different places on, to the right (``step`` 1) or to the left (-1)."""
        begin, number = i, np.arange(len(i))
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in self.levels:
            edge = level.first if step > 0 else level.last
            apart = np.flatnonzero((edge[level.up[i]] != i) | (edge[level.up[j]] != j))
            i, j = i.copy(), j.copy()
            i[apart], j[apart], over = self._agree(level, i[apart], j[apart], step)
            over = apart[over]
            stopped.append((i[over], j[over], number[over]))
            on = np.ones(len(i), bool)
            on[over] = False
            i, j, number = level.up[i[on]], level.up[j[on]], number[on]
        i, j, on = i.copy(), j.copy(), np.arange(len(i))
        while len(on := on[self.top[i[on]] == self.top[j[on]]]):
            i[on] += step
            j[on] += step
        for level, (si, sj, sn) in zip(reversed(self.levels), reversed(stopped)):
            edge = level.first if step > 0 else level.last
            i, j, _ = self._agree(level, edge[i], edge[j], step)
            i, j, number = np.concatenate((i, si)), np.concatenate((j, sj)), np.concatenate((number, sn))
        out = np.empty(len(begin), np.int64)
        out[number] = np.abs(i - begin[number])
        return out

    @staticmethod
    def _agree(level: Level, i: np.ndarray, j: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step within upper symbols: places after it, and where the two are known to differ there.

        In a level of blocks it goes over what both blocks have left, which tells them apart unless it is the same; in a level
        of pairs over one symbol, after which both stand at the edge of an upper symbol.
        """
        same = level.symbols[i] == level.symbols[j]
        if not level.blocks:
            go = np.where(same, step, 0).astype(np.int32)
            return i + go, j + go, ~same
        end = level.last if step > 0 else level.first
        left_i, left_j = np.abs(end[level.up[i]] - i) + 1, np.abs(end[level.up[j]] - j) + 1
        go = np.where(same, step * np.minimum(left_i, left_j), 0).astype(np.int32)
        return i + go, j + go, ~same | (left_i != left_j)


def _stride(period: np.ndarray) -> np.ndarray:
    """A run of this period repeats at its period's distance in so many neighbouring places at least."""
    return np.maximum(LEAST_WORDS, LEAST_EXPONENT * period) - period


def _grid(n: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points (place, period) of a text of n words for the periods from ``least`` up to ``most``."""
    period = np.arange(least, most + 1)
    stride = _stride(period)
    count = np.maximum(0, -(-(n - period) // stride))
    period, stride = np.repeat(period, count), np.repeat(stride, count)
    return (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * stride, period


class _Grids:
    """Grid points of texts of any length; those of shorter texts are the first ones of one list, by the length that needs them."""

    def __init__(self) -> None:
        self.words, self.needs, self.places, self.periods = 0, *[np.empty(0, np.int64)] * 3

    def of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        top = n // LEAST_EXPONENT
        if n < LEAST_WORDS:
            return
        if n <= GRID_WORDS:
            if n > self.words:
                self.words = min(GRID_WORDS, max(1024, 1 << (n - 1).bit_length()))
                place, period = _grid(self.words, 1, self.words // LEAST_EXPONENT)
                needs = np.maximum(np.maximum(place + period + 1, LEAST_EXPONENT * period), LEAST_WORDS)
                order = np.argsort(needs, kind="stable")
                self.needs, self.places, self.periods = needs[order], place[order], period[order]
            m = int(np.searchsorted(self.needs, n, "right"))
            yield self.places[:m], self.periods[:m]
            return
        least = 1
        while least <= top:
            most = min(top, least + max(0, GRID_POINTS * int(_stride(np.int64(least))) // n))
            yield _grid(n, least, most)
            least = most + 1


_grids = _Grids()


def find(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs in several texts at once: text, start, length and period, by text, start and period.

    ``codes`` are the words of all texts one after the other as numbers from 0 on, ``ends`` where each text ends.
    """
    texts, begins = len(ends), np.concatenate(([0], ends[:-1]))
    fences = texts + 1
    where = begins + np.arange(1, texts + 1)  # a fence before each text and one at the end
    fenced = np.insert(codes.astype(np.int64) + fences, np.append(begins, len(codes)), np.arange(fences))
    grammar: Grammar | None = None
    parts = []

    def look(places: list[np.ndarray], periods: list[np.ndarray]) -> None:
        nonlocal grammar
        i, q = np.concatenate(places), np.concatenate(periods)
        hit = fenced[i] == fenced[i + q]
        i, q = i[hit], q[hit]
        if not len(i):
            return
        grammar = grammar or Grammar(fenced, fences)
        i32, j32 = i.astype(np.int32), (i + q).astype(np.int32)
        right, left = grammar.extent(i32, j32, 1), grammar.extent(i32 - 1, j32 - 1, -1)
        length = left + q + right
        long = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
        parts.append(np.unique(np.stack([(i - left)[long], length[long], q[long]]), axis=1))

    places, periods, waiting = [], [], 0
    for at, n in zip(where, ends - begins):
        for place, period in _grids.of(int(n)):
            places.append(place + at)
            periods.append(period)
            waiting += len(place)
            if waiting >= GRID_POINTS:
                look(places, periods)
                places, periods, waiting = [], [], 0
    if places:
        look(places, periods)
    if not any(p.size for p in parts):
        return (np.empty(0, np.int64),) * 4
    # Of the periods of one stretch the smallest is the run's; it comes first.
    start, length, period = np.unique(np.concatenate(parts, axis=1), axis=1)
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(where, start, "right") - 1
    return text, start - where[text], length, period


def periodic_runs(docs: DataFrame, source: Callable[[int | None, int], np.ndarray | None] = lambda doc_id, n: None) -> DataFrame:
    """Runs of each whole text: doc_id, n_words, runs (by start, then period), collapsed (the text without repetitions).

    Words are stretches without ASCII white space. A run is a stretch with smallest period q of at least 6 words and 4 q,
    extended as far as the period holds; ``collapsed`` keeps the first q words of each run and joins words by one space.
    ``source``, if it returns places for (doc_id, n), tells which word of the text stands at each place. Null and empty texts
    have no words and no runs, repeated rows come out alike, other columns are not read. Texts are taken by Arrow batches,
    whose grammar is built as one; memory grows with the longest text of a batch, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            words, of_text = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
            filled = pc.greater(pc.binary_length(words), 0)
            words, of_text = words.filter(filled), of_text[filled.to_numpy(zero_copy_only=False)]
            sizes = np.bincount(of_text, minlength=len(batch))
            ends = np.cumsum(sizes)
            begins = ends - sizes
            ids = batch.column("doc_id").to_pylist()
            order = np.arange(len(words))
            for k, n in enumerate(sizes):
                places = source(ids[k], int(n))
                if places is not None:
                    order[begins[k]:ends[k]] = begins[k] + places
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)[order]
            text, start, length, period = find(codes, ends)
            cover = np.zeros(len(codes) + 1, np.int64)
            np.add.at(cover, begins[text] + start + period, 1)
            np.add.at(cover, begins[text] + start + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
            left = np.bincount(of_text[kept], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                lists(np.bincount(text, minlength=len(batch)), pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])),
                pc.binary_join(lists(left, words.take(pa.array(order[kept]))), " ")], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def repeating(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the contract: from word a on, one document in ten repeats its p words from there."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), repeating)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("less"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")))), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"), F.expr("(1000 * best.length) div -best.less").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
