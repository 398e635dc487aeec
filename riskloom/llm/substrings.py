"""Exact substring deduplication by external induced sorting, to the depth of a match.

A byte goes if a string of MATCH bytes that covers it also starts in a document with a smaller id. Only the order of
suffixes by their first MATCH bytes matters, so sorting is induced from few suffixes:

1. Every window of MATCH bytes picks one of its short strings (GRAM bytes), the one of smallest hash; equal windows pick the
   same. The suffixes at these anchors are the sample. Windows in sequence with one anchor make a span.
2. The sample is named and sorted outside memory: shards hand sorted runs of (name, ...) tuples to buckets of names, where
   the runs are merged, and get answers back. First by the anchor's string: what occurs in one document only is out. Then
   by the whole span, with the smallest document: what occurs in the same span of a smaller document is settled.
3. What is left are spans that agree at the anchor and differ around it. There the order of the sample suffixes, with
   common-prefix lengths, is induced one byte to the left at a time (:func:`induced`): suffixes that share 50 bytes or
   more are one string. An anchor with very many different spans, such as the end of a line that everybody has, is dealt
   out again by the names of its windows, so no bucket holds more than CROWD spans of it.

The shuffle is the disk-backed queue: runs are written sorted and in parts, and no bucket or shard needs memory for more
than itself. Texts are written once, in buckets of their shard, and stay there; tuples and answers travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bucketed, staged, table, text_buckets

MATCH, GRAM = 50, 24
GRAMS = MATCH - GRAM + 1
#: Text of a shard, text that is hashed at once, text for each bucket of names, and spans of an anchor that one bucket sorts.
SHARD_BYTES, SEGMENT, BUCKET_BYTES, CROWD = 2 << 20, 1 << 20, 16 << 20, 20_000

U = np.uint64
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_LAST = np.iinfo(np.int64).max
#: Answers about a span: a smaller document has it; windows of it may be in other spans; others need its windows; crowded.
COVERED, CONTESTED, SOURCE, CROWDED = 1, 2, 4, 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the GRAM bytes and of the 32 bytes from each place on."""
    h, width = _BYTE[data], 1
    while width < 16:
        h, width = h[:-width] * U(0x9E3779B97F4A7C15 + 2 * width) + h[width:], width * 2
    return _mix(h[:16 - GRAM] * U(0xD6E8FEB86659FD93) + h[GRAM - 16:]), h[:-16] * U(0xCA5A826395121157) + h[16:]


class Shard:
    """Spans of a shard's documents: first window, number of windows, anchor, names, document."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes) -> None:
        self.ids, self.ends, self.data = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), np.frombuffer(data, np.uint8)
        parts = [self._spans(lo, min(lo + SEGMENT, len(self.data) - MATCH + 1)) for lo in range(0, max(0, len(self.data) - MATCH + 1), SEGMENT)]
        names = ("start", "count", "anchor", "gram", "span")
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            setattr(self, name, np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind))
        self.doc = np.searchsorted(self.ends, self.start, "right")
        self.id = self.ids[self.doc] if len(self.ids) else np.zeros(0, np.int64)

    def _spans(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        gram, wide = _hashes(self.data[lo:hi + MATCH - 1])
        n = hi - lo
        least = gram & U(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=np.uint64)  # ties go to the left
        width = 1
        while width * 2 <= GRAMS:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        least = np.minimum(least[:n], least[GRAMS - width:GRAMS - width + n])
        anchor = (least & U(0xFFFFFFFF)).astype(np.int64)
        valid = np.ones(n, bool)
        for end in self.ends[np.searchsorted(self.ends, lo, "right"):np.searchsorted(self.ends, hi + MATCH, "left")].tolist():
            valid[max(0, end - MATCH + 1 - lo):max(0, end - lo)] = False  # a window does not cross the end of a document
        change = np.ones(n, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(change)
        count = np.diff(np.append(start, n))
        start, count = start[valid[start]], count[valid[start]]
        anchor = anchor[start]
        first, last = self._window(wide, start), self._window(wide, start + count - 1)
        # The first and the last window cover the span between them.
        span = _mix(first * U(0xD6E8FEB86659FD93) + _mix(last + count.astype(np.uint64) * U(0x9E3779B97F4A7C15)) + (anchor - start).astype(np.uint64))
        return start + lo, count, anchor + lo, gram[anchor], span

    @staticmethod
    def _window(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _mix(wide[at] * U(0xE7037ED1A0B428DB) + wide[at + MATCH - 32])

    def windows(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and name of each window of the spans; the name is the hash of its MATCH bytes."""
        count = self.count[spans]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[spans], count)
        names = np.zeros(len(at), np.uint64)
        for lo in range(0, len(self.data), SEGMENT):
            inside = np.flatnonzero((at >= lo) & (at < lo + SEGMENT))
            if len(inside):
                names[inside] = self._window(_hashes(self.data[lo:lo + SEGMENT + MATCH])[1], at[inside] - lo)
        return at, names


def _runs(names: np.ndarray, buckets: int, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, name and what follows; the buckets there; where each begins."""
    bucket = (names & U(0xFFFFFFFF)) % U(buckets)
    order = np.lexsort((*more[::-1], names, bucket))
    ids, starts = np.unique(bucket[order], return_index=True)
    return order, ids.astype(np.int64), starts


class Work:
    """A shard together with the answers so far; computes the next question and, at last, the bytes that go."""

    def __init__(self, shard: Shard, answers: list[bytes | None], buckets: int) -> None:
        self.shard, self.buckets = shard, buckets
        s = shard
        # Question 1: which anchors' strings occur in another document?
        self.grams, inverse = np.unique(s.gram, return_inverse=True)
        if not answers:
            return
        low, high = np.full(len(self.grams), _LAST), np.full(len(self.grams), -_LAST - 1)
        np.minimum.at(low, inverse, s.id)
        np.maximum.at(high, inverse, s.id)
        order, *_ = _runs(self.grams, buckets)
        elsewhere = np.zeros(len(self.grams), bool)
        if answers[0]:
            elsewhere[order] = np.frombuffer(answers[0], np.uint8) > 0
        self.live = np.flatnonzero((elsewhere | (low < high))[inverse])
        # Question 2: which spans occur in a smaller document?
        pairs = np.stack([s.gram[self.live], s.span[self.live]])
        self.pairs, first, self.pair_of = (np.unique(pairs, axis=1, return_index=True, return_inverse=True) if len(self.live) else
                                           (pairs, np.zeros(0, np.int64), np.zeros(0, np.int64)))
        self.pair_of = self.pair_of.ravel()
        self.least = np.full(self.pairs.shape[1], _LAST)
        np.minimum.at(self.least, self.pair_of, s.id[self.live])
        if len(answers) < 2:
            return
        said = np.zeros(self.pairs.shape[1], np.uint8)
        order, *_ = _runs(self.pairs[0], buckets, self.pairs[1])
        if answers[1]:
            said[order] = np.frombuffer(answers[1], np.uint8)
        self.covered = (said[self.pair_of] & COVERED > 0) | (s.id[self.live] > self.least[self.pair_of])
        # Question 3: which windows of the remaining spans occur in a smaller document? One span stands for all that equal it.
        reps = np.full(self.pairs.shape[1], -1)
        mine = np.flatnonzero(s.id[self.live] == self.least[self.pair_of])
        reps[self.pair_of[mine[::-1]]] = self.live[mine[::-1]]
        asked = said & (CONTESTED | SOURCE) > 0
        self.said, self.reps = said, reps
        self.sorted_pairs = np.flatnonzero(asked & (said & CROWDED == 0))
        self.named_pairs = np.flatnonzero(asked & (said & CROWDED > 0))
        self.window_at, self.window_name = s.windows(reps[self.named_pairs])
        self.window_pair = np.repeat(self.named_pairs, s.count[reps[self.named_pairs]])
        self.names, self.name_of = np.unique(self.window_name, return_inverse=True)
        self.name_least = np.full(len(self.names), _LAST)
        np.minimum.at(self.name_least, self.name_of, self.least[self.window_pair])
        self.answers = answers

    def question1(self) -> Iterator[tuple[int, bytes]]:
        order, ids, starts = _runs(self.grams, self.buckets)
        yield from zip(ids.tolist(), (x.tobytes() for x in np.split((self.grams[order] >> U(32)).astype(np.uint32), starts[1:])), strict=True) if len(ids) else ()

    def question2(self) -> Iterator[tuple[int, bytes]]:
        order, ids, starts = _runs(self.pairs[0], self.buckets, self.pairs[1])
        rows = np.empty(len(order), _SPAN)
        rows["rest"], rows["span"], rows["id"] = (self.pairs[0][order] >> U(32)).astype(np.uint32), self.pairs[1][order], self.least[order]
        yield from zip(ids.tolist(), (x.tobytes() for x in np.split(rows, starts[1:])), strict=True) if len(ids) else ()

    def question3(self) -> Iterator[tuple[int, bytes]]:
        """Spans with their bytes, in buckets of the anchor's string."""
        s, (order, ids, starts) = self.shard, _runs(self.pairs[0][self.sorted_pairs], self.buckets, self.pairs[1][self.sorted_pairs])
        for bucket, part in zip(ids.tolist(), np.split(self.sorted_pairs[order], starts[1:]), strict=True) if len(ids) else ():
            rows = np.zeros(len(part), _TEXT)
            at = self.reps[part]
            rows["rest"], rows["id"], rows["left"], rows["count"] = (self.pairs[0][part] >> U(32)).astype(np.uint32), self.least[part], s.anchor[at] - s.start[at], s.count[at]
            reach = np.arange(SPAN_BYTES)
            place = np.minimum(s.start[at][:, None] + reach, len(s.data) - 1)
            rows["text"] = np.where(reach < (s.count[at] + MATCH - 1)[:, None], s.data[place], 0)
            yield bucket, rows.tobytes()

    def question4(self) -> Iterator[tuple[int, bytes]]:
        """Windows of crowded anchors by their names."""
        order, ids, starts = _runs(self.names, self.buckets)
        rows = np.empty(len(order), _NAME)
        rows["name"], rows["id"] = self.names[order], self.name_least[order]
        yield from zip(ids.tolist(), (x.tobytes() for x in np.split(rows, starts[1:])), strict=True) if len(ids) else ()

    def removed(self) -> np.ndarray:
        """Which bytes of the shard go."""
        s = self.shard
        edge = np.zeros(len(s.data) + 1, np.int64)
        gone = self.live[self.covered]
        np.add.at(edge, s.start[gone], 1)
        np.add.at(edge, s.start[gone] + s.count[gone] + MATCH - 1, -1)
        hit = np.zeros(self.pairs.shape[1], np.uint32)
        order, *_ = _runs(self.pairs[0][self.sorted_pairs], self.buckets, self.pairs[1][self.sorted_pairs])
        if self.answers[2]:
            hit[self.sorted_pairs[order]] = np.frombuffer(self.answers[2], np.uint32)
        smaller = np.zeros(len(self.names), bool)
        order, *_ = _runs(self.names, self.buckets)
        if self.answers[3]:
            smaller[order] = np.frombuffer(self.answers[3], np.uint8) > 0
        taken = smaller[self.name_of] | (self.least[self.window_pair] > self.name_least[self.name_of])
        bit = self.window_at - s.start[self.reps[self.window_pair]]
        np.bitwise_or.at(hit, self.window_pair[taken], np.uint32(1) << bit[taken].astype(np.uint32))
        rest = self.live[~self.covered]
        bits = hit[self.pair_of[~self.covered]]
        for i in range(GRAMS):
            at = s.start[rest[bits >> np.uint32(i) & np.uint32(1) > 0]] + i
            np.add.at(edge, at, 1)
            np.add.at(edge, at + MATCH, -1)
        return np.cumsum(edge)[:-1] > 0


SPAN_BYTES = MATCH + GRAMS - 1
_SPAN = np.dtype([("rest", "<u4"), ("span", "<u8"), ("id", "<i8")])
_TEXT = np.dtype([("rest", "<u4"), ("id", "<i8"), ("left", "u1"), ("count", "u1"), ("text", "u1", (SPAN_BYTES,))])
_NAME = np.dtype([("name", "<u8"), ("id", "<i8")])


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Number of the group of equal rows, for sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def shared_grams(runs: list[np.ndarray]) -> list[np.ndarray]:
    """Which strings are in more than one shard's run."""
    every = np.concatenate(runs)
    names, counts = np.unique(every, return_counts=True)
    found = counts[np.searchsorted(names, every)] > 1
    return np.split(found.astype(np.uint8), np.cumsum([len(r) for r in runs])[:-1])


def judged_spans(runs: list[np.ndarray]) -> list[np.ndarray]:
    every = np.concatenate(runs)
    order = np.lexsort((every["id"], every["span"], every["rest"]))
    rest, span, ids = every["rest"][order], every["span"][order], every["id"][order]
    anchor, one = _groups(rest), _groups(rest, span)
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
    least, of_anchor = ids[first], anchor[first]  # per span
    n = int(anchor[-1]) + 1
    spans = np.bincount(of_anchor, minlength=n)
    by = np.lexsort((least, of_anchor))
    head = np.searchsorted(of_anchor[by], np.arange(n))
    best = by[head]
    second = np.full(n, _LAST)
    more = spans > 1
    second[more] = least[by[head[more] + 1]]
    other = np.where(best[of_anchor] == np.arange(len(first)), second[of_anchor], least[best][of_anchor])
    covered = least[one] < ids
    contested = ~covered & (other[one] < ids)
    needed = np.zeros(n, bool)
    needed[anchor[contested]] = True
    said = covered * COVERED + contested * CONTESTED + (needed[anchor] & (ids == least[one])) * SOURCE + (spans[anchor] > CROWD) * CROWDED
    out = np.empty(len(every), np.uint8)
    out[order] = said
    return np.split(out, np.cumsum([len(r) for r in runs])[:-1])


def induced(anchor: np.ndarray, ids: np.ndarray, left: np.ndarray, count: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Bits of the windows of each span that also lie in a span of a smaller id with the same anchor.

    ``left`` bytes of ``text`` stand before the anchor. The suffixes at the anchors are sorted, with the lengths of common
    prefixes of neighbours; the suffixes one byte further left follow from them by that byte and the order so far, and the
    common prefixes by the least of those between, plus one.
    """
    n, rows = len(anchor), np.arange(len(anchor))
    size = count + MATCH - 1
    reach = np.arange(MATCH)
    right = np.where(left[:, None] + reach < size[:, None], text[rows[:, None], np.minimum(left[:, None] + reach, text.shape[1] - 1)].astype(np.int16), -1)
    words = np.stack([np.where(right[:, i] < 0, 0, right[:, i] + 1) for i in range(MATCH)], 1)
    order = np.lexsort((*words.T[::-1], anchor))
    same = (words[order][1:] == words[order][:-1]) & (right[order][1:] >= 0)
    prefix = np.append(0, np.where(anchor[order][1:] == anchor[order][:-1], np.cumprod(same, 1).sum(1), 0))  # with the one before
    hit = np.zeros(n, np.uint32)
    for back in range(GRAMS):
        if back:
            keep = np.flatnonzero(left[order] >= back)
            table_of = _minima(prefix)
            byte = text[order[keep], left[order[keep]] - back]
            by = keep[np.lexsort((keep, byte, anchor[order[keep]]))]  # byte, then the order one to the right
            chosen = order[by]
            alike = (anchor[chosen][1:] == anchor[chosen][:-1]) & (text[chosen[1:], left[chosen[1:]] - back] == text[chosen[:-1], left[chosen[:-1]] - back])
            between = _least_between(table_of, by[:-1] + 1, by[1:])
            prefix = np.append(0, np.where(alike, between + 1, 0)) if len(chosen) else np.zeros(0, np.int64)
            order = chosen
            if not len(order):
                break
        string = np.cumsum(prefix < MATCH)  # one number for all that share MATCH bytes
        least = np.full(int(string[-1]) + 1, _LAST) if len(string) else np.zeros(0, np.int64)
        np.minimum.at(least, string, ids[order])
        window = left[order] - back
        taken = (least[string] < ids[order]) & (window >= 0) & (window < count[order])
        hit[order[taken]] |= np.uint32(1) << window[taken].astype(np.uint32)
    return hit


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Least values over 1, 2, 4, ... places from each on."""
    out, width = [values], 1
    while width * 2 <= len(values):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out


def _least_between(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value from low to high, both included; where low > high (out of order) the answer is unused."""
    length = np.maximum(high - low + 1, 1)
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.zeros(len(low), np.int64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        a = np.clip(low[at], 0, len(levels[k]) - 1)
        b = np.clip(high[at] - (1 << k) + 1, 0, len(levels[k]) - 1)
        out[at] = np.minimum(levels[k][a], levels[k][b])
    return out


def sorted_spans(runs: list[np.ndarray]) -> list[np.ndarray]:
    every = np.concatenate(runs)
    hit = induced(every["rest"].astype(np.int64), every["id"].astype(np.int64), every["left"].astype(np.int64), every["count"].astype(np.int64), every["text"])
    return np.split(hit, np.cumsum([len(r) for r in runs])[:-1])


def judged_windows(runs: list[np.ndarray]) -> list[np.ndarray]:
    every = np.concatenate(runs)
    names, inverse = np.unique(every["name"], return_inverse=True)
    least = np.full(len(names), _LAST)
    np.minimum.at(least, inverse, every["id"])
    return np.split((least[inverse] < every["id"]).astype(np.uint8), np.cumsum([len(r) for r in runs])[:-1])


#: Rounds of questions: how a shard asks, how a bucket reads its runs, and how it answers. Questions of a round go out together.
ROUNDS: list[list[tuple[str, np.dtype, Callable]]] = [
    [("question1", np.dtype("<u4"), shared_grams)],
    [("question2", _SPAN, judged_spans)],
    [("question3", _TEXT, sorted_spans), ("question4", _NAME, judged_windows)],
]
ANSWERS = sum(map(len, ROUNDS))


def _packed(shard_bytes: int):
    """Documents of a task in shards of their own: ids, ends and texts in one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            order = np.array([_LAST if i is None else i for i in ids], np.int64)  # a null id is the largest
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([order.tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary()),
                 pa.array([b"".join(parts)], pa.binary())], ["shard", "doc_ids", "ids", "ends", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if parts and size + len(text or b"") > shard_bytes:
                    yield row()
                    number, ids, parts, size = number + 1, [], [], 0
                ids.append(doc_id)
                parts.append(text or b"")
                size += len(parts[-1])
        if parts:
            yield row()
    return run


def _asking(questions: list[str], answers: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for work, number in _works(batch, answers, buckets):
                rows = [(kind, *row) for kind, question in enumerate(questions) for row in getattr(work, question)()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))]],
                    ["shard", "kind", "bucket", "run"])
    return run


def _works(batch: pa.RecordBatch, answers: int, buckets: int) -> Iterator[tuple[Work, int]]:
    for i in range(batch.num_rows):
        shard = Shard(*(batch.column(c)[i].as_py() for c in ("ids", "ends", "data")))
        said = [b"".join(a["answer"] for a in batch.column(f"answer{k}")[i].as_py() or ()) for k in range(answers)]
        yield Work(shard, said, buckets), batch.column("shard")[i].as_py()


def _answering(kinds: list[np.dtype], judges: list[Callable]):
    def run(part: pa.Table) -> pa.Table:
        kind = part.column("kind")[0].as_py()
        runs = [np.frombuffer(x, kinds[kind]) for x in part.column("run").to_pylist()]
        answers = pa.array([x.tobytes() for x in judges[kind](runs)], pa.binary())
        return pa.table([*(part.column(c) for c in ("shard", "kind", "bucket")), answers], ["shard", "kind", "bucket", "answer"])
    return run


def deduplicate(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, n_bytes, removed (maximal runs of start and length, in bytes) and kept (the remaining bytes).

    Texts are UTF-8 bytes, null counts as empty; matches lie within one document, and count in the input. Rows of one id
    are no sources for each other, a null id is larger than all others, every row has a result, an empty table gives none.
    Other columns are not read. Anchors' strings, spans and crowded windows are compared by 64-bit hashes and more.
    """
    text = F.col("text").cast("string").cast("binary")
    buckets = text_buckets(docs, "text", BUCKET_BYTES)
    # Shards grow with the input, so that the number of runs, shards times buckets, grows with it and not with its square.
    shard_bytes = min(256 << 20, max(SHARD_BYTES, buckets * BUCKET_BYTES // 4096))
    packed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(
        _packed(shard_bytes), "shard long, doc_ids array<bigint>, ids binary, ends binary, data binary")
    held = bucketed(packed, "shard", buckets, "substring_shards")
    known = 0
    for questions in ROUNDS:
        names, kinds, judges = (list(x) for x in zip(*questions, strict=True))
        needed = held.select("shard", "ids", "ends", "data", *[f"answer{i}" for i in range(known)])
        asked = needed.mapInArrow(_asking(names, known, buckets), "shard long, kind int, bucket long, run binary")
        replies = staged(asked.groupBy("kind", "bucket").applyInArrow(
            _answering(kinds, judges), "shard long, kind int, bucket long, answer binary"), names[0])
        of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("bucket", "answer"))))
        by_shard = replies.groupBy("shard").agg(*[of(i).alias(f"answer{known + i}") for i in range(len(names))])
        held = held.join(by_shard, "shard", "left")
        known += len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (work, _) in enumerate(_works(batch, ANSWERS, buckets)):
                gone, data = work.removed(), work.shard.data
                ids, sizes, runs, kept, start = batch.column("doc_ids")[i].as_py(), [], [], [], 0
                for end in work.shard.ends.tolist():
                    out = gone[start:end]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                    runs.append([{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()])
                    kept.append(data[start:end][~out].tobytes())
                    sizes.append(end - start)
                    start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                     pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return held.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:bigint,length:bigint>>, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, pos, substr(h, 2 * pos + 1, 2 * (256 + 49)) AS part FROM (SELECT *, unnest(range(0::BIGINT, (length(h) // 2 - 49)::BIGINT, 256::BIGINT)) AS pos FROM d WHERE length(h) >= 100)),
w AS (SELECT r, doc_id, pos + j AS i, substr(part, 2 * j + 1, 100) AS win FROM (SELECT *, unnest(range(0, (length(part) // 2 - 49)::BIGINT)) AS j FROM p)),
m AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
g AS (SELECT w.r, w.i FROM w JOIN m USING (win) WHERE m.first < w.doc_id),
n AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM g)),
s AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY r, run),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
t AS (SELECT d.r, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS kept, count(*) AS n_spans, sum(b - a) AS n_removed
      FROM k JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
