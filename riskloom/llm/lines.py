"""Fuzzy line deduplication by MinHash.

Lines become sets of character shingles. A signature of one-permutation MinHash values is cut into bands; lines that agree
in a band are candidates, candidates are verified by the exact Jaccard similarity of their sets, verified pairs are joined
by distributed union-find, and of each component the first line in the corpus stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from riskloom.llm.common import bucketed, components, prepare, staged, table, text_buckets

SHINGLE, SIMILARITY = 6, 0.8
#: 16 bands of 5: of two lines at similarity 0.8, 998 in 1000 agree in a band; at 0.85 nearly all.
BANDS, ROWS = 16, 5
BINS = BANDS * ROWS
#: Lines of a band's group that are paired with each other; in larger groups all are paired with LEADS of them first.
PAIRED, LEADS = 6, 4
#: Lines of a block when large groups are compared.
TILE_LINES = 2000
#: Text of a bucket, and lines whose band entries a task gathers before it hands them on.
BUCKET_BYTES, FLUSH_LINES = 16 << 20, 100_000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ENTRY = np.dtype([("rest", "<u4"), ("key", "<i8")])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def key_of(line: str) -> int | None:
    """Identity of a line without the white space around it; blank lines have none and are never repeated lines."""
    line = line.strip()
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63) if line else None


def shingles(line: str) -> set[str]:
    line = line.strip()
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each shingle of each line, repeats included; the number of its line, and how many each line has."""
    stripped = [x.strip() for x in lines]
    lengths = np.array([len(x) for x in stripped], np.int64)
    padded = np.maximum(lengths, SHINGLE)  # a shorter line is one shingle
    codes = np.frombuffer("".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in stripped).encode("utf-32-le"), np.uint32).astype(np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    doubled, width = codes, 1
    while width * 2 <= SHINGLE:  # hash of a shingle from those of its halves
        factor = np.uint64(pow(int(base), width, 1 << 64))
        doubled, width = doubled[:-width] * factor + doubled[width:], width * 2
    rest = SHINGLE - width
    if rest:  # overlapping halves cover the shingle
        doubled = doubled[:-rest] * np.uint64(0xD6E8FEB86659FD93) + doubled[rest:]
    counts = padded - SHINGLE + 1
    starts = np.cumsum(padded) - padded
    owner = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    return doubled[at], owner, counts


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sets of shingles as sorted numbers, one line's after the other's, and where each set ends.

    A number is the line's place above as many bits of a shingle's hash as are left, 54 for a batch of 1,000 lines.
    """
    hashes, owner, _ = _hashed(lines)
    bits = max(1, (len(lines) - 1).bit_length())
    numbers = np.sort(owner.astype(np.uint64) << np.uint64(64 - bits) | _mix(hashes) >> np.uint64(bits))
    numbers = numbers[np.r_[True, numbers[1:] != numbers[:-1]]]
    return numbers, np.searchsorted(numbers >> np.uint64(64 - bits), np.arange(len(lines)), "right")


_PROBES = np.random.default_rng(17).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def signatures(lines: list[str]) -> np.ndarray:
    """A row of BINS minima per line. Each shingle falls into one bin; an empty bin takes the value of another one, tried in
    an order of its own, so that equal sets keep equal rows and the rows of similar sets agree as often as the sets do."""
    hashes, owner, _ = _hashed(lines)
    hashes = _mix(hashes)
    slot = (hashes >> np.uint64(40)).astype(np.int64) % BINS
    out = np.full(len(lines) * BINS, _EMPTY)
    np.minimum.at(out, owner * BINS + slot, hashes)
    out = out.reshape(-1, BINS)
    full = out.copy()
    row, column = np.nonzero(out == _EMPTY)
    for step in range(BINS):
        if not len(row):
            break
        found = out[row, _PROBES[column, step]]
        hit = found != _EMPTY
        full[row[hit], column[hit]] = found[hit]
        row, column = row[~hit], column[~hit]
    return full


def band_hashes(rows: np.ndarray) -> np.ndarray:
    parts = rows.reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2])
    for i in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


def _entries(buckets: int):
    """Band entries of distinct lines, packed by bucket of the band hash."""
    def flushed(known: dict[int, str]) -> pa.RecordBatch:
        keys = np.fromiter(known, np.int64, len(known))
        lines, hashes = list(known.values()), []
        for i in range(0, len(lines), 2000):
            hashes.append(band_hashes(signatures(lines[i:i + 2000])).ravel())
        flat = np.concatenate(hashes)
        packed = np.empty(len(flat), _ENTRY)
        packed["rest"], packed["key"] = (flat >> np.uint64(32)).astype(np.uint32), np.repeat(keys, BANDS)
        bucket = ((flat & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        packed, ids, ends = packed[order], *np.unique(bucket, return_counts=True)
        cuts = np.split(packed, np.cumsum(ends)[:-1])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([c.tobytes() for c in cuts], pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, str] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for line in (text or "").split("\n"):
                    key = key_of(line)
                    if key is not None:
                        known[key] = line
                if len(known) >= FLUSH_LINES:
                    yield flushed(known)
                    known = {}
        if known:
            yield flushed(known)

    return run


def _candidates(part: pa.Table) -> pa.Table:
    """Groups of a bucket: pairs (a, b), and for groups of more than PAIRED lines also their members (a, a) with the group."""
    entries = np.concatenate([np.frombuffer(x, _ENTRY) for x in part.column("entries").to_pylist()])
    rest, key = entries["rest"], entries["key"]
    order = np.lexsort((key, rest))
    rest, key = rest[order], key[order]
    fresh = np.r_[True, (rest[1:] != rest[:-1]) | (key[1:] != key[:-1])]
    rest, key = rest[fresh], key[fresh]
    first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
    size = np.diff(np.r_[first, len(rest)])
    a, b, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(x: np.ndarray, y: np.ndarray, group: int) -> None:
        a.append(x)
        b.append(y)
        groups.append(np.full(len(x), group))

    for n in range(2, PAIRED + 1):
        at = first[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                add(key[at + i], key[at + j], -1)
    bucket = int(part.column("bucket")[0].as_py())
    for at, n in zip(first[size > PAIRED].tolist(), size[size > PAIRED].tolist(), strict=True):
        members = key[at:at + n]
        # Each group has leads of its own, so that no odd line stands before all groups of a large component.
        leads = members[np.argsort(_mix(members.astype(np.uint64) ^ np.uint64(rest[at])))[:LEADS]]
        for lead in leads:
            add(np.full(n, lead), members, -1)
        add(members, members, bucket << 32 | int(rest[at]))
    columns = [np.concatenate(x) for x in (a, b, groups)]
    return pa.table([pa.array(x, pa.int64()) for x in columns], ["a", "b", "crowd"])


def similar(lines: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x[i], y[i]) of these lines reach SIMILARITY, by their whole sets."""
    numbers, ends = shingle_sets(lines)
    begins = np.r_[0, ends[:-1]]
    size = ends - begins
    own = np.uint64((1 << 64 - max(1, (len(lines) - 1).bit_length())) - 1)
    top = np.uint64(64 - max(1, (len(x) - 1).bit_length()))
    low = np.uint64(max(0, (len(x) - 1).bit_length() - max(1, (len(lines) - 1).bit_length())))  # bits of hash that pairs leave

    def by_pair(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = size[line]
        pair = np.repeat(np.arange(len(line)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[line], count)
        return pair.astype(np.uint64) << top | (numbers[at] & own) >> low, pair

    (one, _), (other, pair) = by_pair(x), by_pair(y)
    place = np.minimum(np.searchsorted(one, other), len(one) - 1)
    both = np.bincount(pair[one[place] == other], minlength=len(x))
    return both >= SIMILARITY * (size[x] + size[y] - both)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        keys = np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")])
        _, first, line = np.unique(keys, return_index=True, return_inverse=True)
        texts = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]).take(pa.array(first)).to_pylist()
        kept = similar(texts, line[:len(batch)], line[len(batch):])
        yield batch.select(["a", "b"]).filter(pa.array(kept))


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each text, with the size of their sets."""
    for batch in batches:
        keys, found = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            lines = text.split("\n")
            keys += [w["key"] for w in wanted]
            found += [lines[w["at"]].strip() for w in wanted]
        sizes = [np.diff(np.r_[0, shingle_sets(found[i:i + 1000])[1]]) for i in range(0, len(found), 1000)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(np.concatenate(sizes or [np.zeros(0)]), pa.int64()), pa.array(found, pa.string())], ["key", "size", "line"])


def _texts_of(keys: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """key, size and line for the lines in candidates only, from one place each."""
    spots = places.groupBy("key").agg(F.min(F.struct("uid", "at")).alias("spot")).join(keys.distinct(), "key", "left_semi")
    by_doc = spots.groupBy(F.col("spot.uid").alias("uid")).agg(F.collect_list(F.struct("key", F.col("spot.at").alias("at"))).alias("wanted"))
    texts = docs.select("uid", F.col("row.text").cast("string").alias("text")).join(by_doc, "uid").select("text", "wanted")
    return staged(texts.mapInArrow(_pick, "key long, size long, line string"), "line-texts")


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) whose lines are similar. Sets whose sizes differ too much are not even compared."""
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    sizes = found.select("key", "size")
    alike = pairs.join(sizes.select(F.col("key").alias("a"), F.col("size").alias("size_a")), "a").join(
        sizes.select(F.col("key").alias("b"), F.col("size").alias("size_b")), "b").where(_fitting("size_a", "size_b")).select("a", "b")
    both = alike.join(found.select(F.col("key").alias("a"), F.col("line").alias("text_a")), "a").join(
        found.select(F.col("key").alias("b"), F.col("line").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long")


def _fitting(one: str, other: str) -> Column:
    return F.least(one, other) >= SIMILARITY * F.greatest(one, other)


def _late_links(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of a group ``main`` in which a lies outside the main component and b in another one than a.

    Members and outsiders are cut into blocks of TILE_LINES, and each pair of blocks is one task's work.
    """
    outside = F.col("root") != F.col("main")
    sizes = groups.groupBy("main").agg(F.ceil(F.count("*") / TILE_LINES).cast("int").alias("n_blocks"),
                                       F.ceil(F.count(F.when(outside, 1)) / TILE_LINES).cast("int").alias("n_outer")).where("n_outer > 0")
    sized = groups.join(sizes, "main")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda seed, n: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    inner = sized.select("main", "key", "root", F.lit(False).alias("outer"), share(1, "n_blocks").alias("block"), each("n_outer").alias("outer_block"))
    outer = sized.where(outside).select("main", "key", "root", F.lit(True).alias("outer"), each("n_blocks").alias("block"), share(2, "n_outer").alias("outer_block"))
    tiles = inner.union(outer).join(found.select("key", "line"), "key")
    return tiles.groupBy("main", "block", "outer_block").applyInArrow(_tile, "a long, b long")


def _tile(part: pa.Table) -> pa.Table:
    """Exact similarities of the outsiders of a tile with its members, counted over the members that share each shingle."""
    keys, roots, outer = (np.array(part.column(c).to_pylist()) for c in ("key", "root", "outer"))
    numbers: dict[str, int] = {}
    sets = [np.array([numbers.setdefault(x, len(numbers)) for x in shingles(line)], np.int64) for line in part.column("line").to_pylist()]
    size = np.array([len(x) for x in sets], np.int64)
    inner = np.flatnonzero(~outer)
    tokens = np.concatenate([sets[i] for i in inner] or [np.zeros(0, np.int64)])
    order = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(len(inner)), size[inner])[order]
    first = np.searchsorted(tokens[order], np.arange(len(numbers) + 1))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(outer).tolist():
        low, count = first[sets[i]], first[sets[i] + 1] - first[sets[i]]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        both = np.bincount(owner[at], minlength=len(inner))
        near = (both >= SIMILARITY * (size[i] + size[inner] - both)) & (roots[inner] != roots[i])
        b.append(keys[inner[near]])
        a.append(np.full(int(near.sum()), keys[i]))
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])


def line_components(places: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """key and component of lines that have a similar line of another text."""
    packed = docs.select(F.col("row.text").cast("string").alias("text")).mapInArrow(_entries(buckets), "bucket long, entries binary")
    candidates = staged(packed.groupBy("bucket").applyInArrow(_candidates, "a long, b long, crowd long"), "line-candidates")
    found = _texts_of(candidates.select(F.col("a").alias("key")).union(candidates.select("b")), places, docs)
    links = staged(_verified(candidates.where("a <> b").select("a", "b"), found), "line-links")
    firsts = staged(components(links, "line-components"), "line-first")
    # Whoever of a large group did not join its main component is compared with all members outside its own.
    members = candidates.where("crowd >= 0").select("crowd", F.col("a").alias("key"))
    crowds = members.join(firsts.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("component", "key"))
    crowds = staged(crowds.select("crowd", "key", "root"), "line-crowds")
    main = crowds.groupBy("crowd", "root").count().groupBy("crowd").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    groups = crowds.join(main, "crowd").select("main", "key", "root").distinct()
    first = firsts.select(F.col("node").alias("key"), "component")
    if groups.where("root <> main").isEmpty():
        return first
    more = staged(_late_links(groups, found), "line-links")
    # The late links join components, not lines.
    root_of = lambda df, c: df.join(first.select(F.col("key").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    joined = staged(components(root_of(root_of(more, "a"), "b"), "line-components"), "line-joined")
    moved = first.join(joined.select(F.col("node").alias("component"), F.col("component").alias("later")), "component", "left").select("key", F.coalesce("later", "component").alias("component"))
    alone = joined.select(F.col("node").alias("key"), "component").join(first.select("key"), "key", "left_anti")
    return moved.union(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``row``, with its ``text`` after removal, ``n_lines`` and ``removed`` (their numbers from 0).

    A line is what stands between line feeds; white space around it does not count. Lines are one if equal, or if the Jaccard
    similarity of their sets of SHINGLE characters in sequence is SIMILARITY or more along a path; a line shorter than that
    equals its like only. The first of a component stays: in the row with the smallest doc_id (null last), then the first
    row in the input, then the first line. Blank lines stay. Null texts have no lines and stay null; repeated rows lose their
    lines to the first of them; columns of any name stay inside ``row``. A text that loses all its lines is empty.
    """
    buckets = text_buckets(docs, "text", BUCKET_BYTES)
    held = bucketed(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*docs.columns).alias("row")), "uid", buckets, "line_docs")
    keys = StructType([StructField("uid", LongType()), StructField("keys", ArrayType(LongType()))])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else [key_of(x) for x in t.split("\n")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(found, pa.list_(pa.int64()))], ["uid", "keys"])

    per_doc = held.select("uid", F.col("row.text").cast("string").alias("text")).mapInArrow(keyed, keys)
    ids = held.select("uid", F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").cast("long").alias("doc_id"))
    places = staged(per_doc.join(ids, "uid").select("uid", "no_id", "doc_id", F.posexplode("keys").alias("at", "key")).where("key is not null"), "line-places")
    found = line_components(places, held, buckets)
    rooted = staged(places.join(found, "key", "left").select("uid", "no_id", "doc_id", "at", F.coalesce("component", "key").alias("root")), "line-rooted")
    rank = F.struct("no_id", "doc_id", "uid", "at")
    # Written, so that the join has two plain exchanges and the places of a very frequent line are split among tasks.
    firsts = staged(rooted.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first.uid", "first.at"), "line-firsts")
    repeated = rooted.alias("l").join(firsts.alias("f"), F.col("l.root") == F.col("f.root")).where("l.uid <> f.uid or l.at <> f.at")
    removed = repeated.select("l.uid", "l.at").groupBy("uid").agg(F.sort_array(F.collect_list("at")).alias("removed"))
    joined = held.join(removed, "uid", "left").select("row", "removed")
    schema = StructType([*joined.schema.fields[:1], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("removed", ArrayType(LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            kept, counts, gone = [], [], []
            for text, out in zip(rows.field("text").cast(pa.string()).to_pylist(), batch.column("removed").to_pylist(), strict=True):
                lines, drop = [] if text is None else text.split("\n"), set(out or ())
                kept.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in drop))
                counts.append(len(lines))
                gone.append(out or [])
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int64()))], ["row", "text", "n_lines", "removed"])

    return joined.mapInArrow(cut, schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    return out.select("row.doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without its repeated lines; n_chars follows the text."""
    prepare(spark)
    out = deduplicate(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
