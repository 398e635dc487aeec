"""Exact top-k inner-product search by tiles.

Vectors are packed into shards, queries into blocks. Each tile (one block of queries, one shard) is one matrix product; the
best k per query are selected inside the tile, and the lists of the tiles are merged in a tree, first those of a task. Tiles are
made where shards and blocks are read: neither is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import staged, table

K = 20
#: Vectors of a shard, queries of a block, and tiles whose lists are merged at once.
SHARD_ROWS, QUERY_ROWS, FAN_IN = 4096, 1024, 32
SCALE = 64
#: The least score there is.
LOWEST = -(2 ** 63) + 1


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Gathers a task's rows, which are few by the choice of partitions, into one matrix for each vector length."""
    part = TaskContext.get().partitionId()
    rows: dict[int, list[list]] = {}
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in (*columns, "cells")]
        for row in zip(*values, strict=True):
            kept = rows.setdefault(len(row[-1]), [[] for _ in row])
            for out, x in zip(kept, row, strict=True):
                out.append(x)
    for size, kept in rows.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([size // 8], pa.int32()),
             *[pa.array([x], pa.list_(pa.int64())) for x in kept[:-1]], pa.array([b"".join(kept[-1])], pa.binary())],
            ["block", "dim", *columns, "cells"])


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, dim)


def _finite(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as doubles. Rows with a null id, a null or empty vector, or a null or non-finite component
    take no part."""
    v = F.col("v")
    plain = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return plain.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _packed(vectors: DataFrame) -> DataFrame:
    """vec_id and cells, the components as packed doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            parts = np.split(v.flatten().to_numpy(), np.diff(v.offsets.to_numpy()).cumsum()[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in parts[:len(v)]], pa.binary())], ["vec_id", "cells"])

    return vectors.mapInArrow(run, "vec_id long, cells binary")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and cells, the components as packed doubles, of the rows that take part."""
    return _packed(_finite(vectors))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) exactly; a double from 2**53 on is whole, so it is multiplied as an integer and cannot overflow."""
    return int(x) * scale if abs(x) >= 2.0 ** 53 else math.floor(scale * x)


def _scores(queries: np.ndarray, shard: np.ndarray, scale: int) -> np.ndarray:
    """Exact integer products of floor(scale * x): by floats while every sum stays below 2**24, by doubles below 2**53, else by
    Python's integers. A score beyond 64 bits counts as the nearest that fits."""
    with np.errstate(over="ignore", invalid="ignore"):
        q, s = np.floor(scale * queries), np.floor(scale * shard)
        bound = np.abs(q).max(initial=0) * np.abs(s).max(initial=0) * queries.shape[1]
    if bound < 2.0 ** 53:
        kind = np.float32 if bound < 2.0 ** 24 else np.float64
        return q.astype(kind) @ s.astype(kind).T
    whole = lambda m: np.array([[_whole(x, scale) for x in row] for row in m.tolist()], object).reshape(m.shape)
    exact = whole(queries) @ whole(shard).T
    return np.clip(exact, LOWEST, 2 ** 63 - 1).astype(np.int64)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k highest scores; columns are in order of preference for ties."""
    n = scores.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(scores)), n), np.tile(np.arange(n), len(scores))
    last = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above = scores > last
    ties = scores == last
    room = k - above.sum(1, keepdims=True)
    return np.nonzero(above | (ties & (np.cumsum(ties, 1) <= room)))


def _reached(scores: np.ndarray, k: int) -> np.ndarray:
    """A score that k columns of each row reach: the k-th highest of the maxima of groups of columns."""
    n = scores.shape[1]
    groups = min(n, 8 * k)
    if groups < k:
        return np.full(len(scores), LOWEST)
    tops = scores[:, :n - n % groups].reshape(len(scores), -1, groups).max(1)
    return np.partition(tops, groups - k, axis=1)[:, groups - k]


class _Lists:
    """The k best of every query of a block over the tiles of a task, as columns: query, score, vec_id, shard, at."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(n_queries, LOWEST)
        self.columns = [np.zeros(0, np.int64)] * 5

    def add(self, scores: np.ndarray, ids: np.ndarray, shard: int, at: np.ndarray) -> None:
        """Merges a tile. Only scores that a full list does not exceed are looked at, and the k best of a row with many of them."""
        least = self.floor.astype(scores.dtype)
        if (self.floor == LOWEST).any():
            least = np.maximum(least, _reached(scores, self.k).astype(scores.dtype))
        chosen = scores >= least[:, None]
        many = np.flatnonzero(np.count_nonzero(chosen, axis=1) > 4 * self.k)
        if len(many):
            row, column = _best(scores[many], self.k)
            chosen[many] = False
            chosen[many[row], column] = True
        q, c = np.divmod(np.flatnonzero(chosen), scores.shape[1])
        if not len(q):
            return
        tile = (q, scores[q, c].astype(np.int64), ids[c], np.full(len(q), shard), at[c])
        query, score, vec_id, shards, places = merged = [np.concatenate(x) for x in zip(self.columns, tile, strict=True)]
        order = np.lexsort((places, shards, vec_id, -score, query))
        query, score = query[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.columns = [x[order[rank < self.k]] for x in merged]
        self.floor[query[rank == self.k - 1]] = score[rank == self.k - 1]


def search(vectors: DataFrame, k: int = K, every: int = 20, scale: int = SCALE) -> DataFrame:
    """Each query's k highest scores: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of the same length but the query's own
    row. Scores are held to 64 bits, ties go to the smaller vec_id. A repeated id is another row: it is a candidate of its twin, and each row with the
    id of a query is a query. Fewer candidates give shorter lists; an empty table gives none. Other columns are not read.
    """
    finite = _finite(vectors)
    n, n_queries = finite.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    rows = _packed(finite)
    shards = max(1, math.ceil(n / SHARD_ROWS))
    listed = lambda names: ", ".join(f"{c} array<bigint>" for c in names)
    table_of = staged(rows.repartition(shards).mapInArrow(lambda b: _blocks(b, ("vec_id",)),
                                                          f"block int, dim int, {listed(['vec_id'])}, cells binary"), "topk-shards")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, ids, cells in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "vec_id", "cells")), strict=True):
                matrix = _matrix(cells, dim)
                at = [i for i, x in enumerate(ids) if x % every == 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([ids[i] for i in at], pa.int64()),
                     pa.array([matrix[i].tobytes() for i in at], pa.binary())], ["own_block", "own_at", "query_id", "cells"])

    queries = table_of.mapInArrow(chosen, "own_block long, own_at long, query_id long, cells binary")
    blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    names = ("own_block", "own_at", "query_id")
    query_blocks = staged(queries.repartition(blocks).mapInArrow(lambda b: _blocks(b, names),
                                                                 f"block int, dim int, {listed(names)}, cells binary"), "topk-queries")

    # Every block of queries meets every shard once, without a shuffle; vectors of another length are passed over in the task.
    left = table_of.select(F.col("block").alias("shard"), "dim", "vec_id", F.col("cells").alias("shard_cells"))
    right = query_blocks.select(F.col("block").alias("query_block"), F.col("dim").alias("query_dim"), *names, F.col("cells").alias("query_cells"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[_Lists, np.ndarray, np.ndarray]] = {}
        columns = ("shard", "dim", "vec_id", "shard_cells", "query_block", "query_dim", *names, "query_cells")
        for batch in batches:
            for row in range(batch.num_rows):
                shard, dim, ids, cells, block, query_dim, own_block, own_at, query_id, query_cells = (batch.column(c)[row] for c in columns)
                shard, dim, block = shard.as_py(), dim.as_py(), block.as_py()
                if dim != query_dim.as_py():
                    continue
                ids, own_block, own_at, query_id = (x.values.to_numpy() for x in (ids, own_block, own_at, query_id))
                order = np.argsort(ids, kind="stable")
                scores = _scores(_matrix(query_cells.as_buffer(), dim), _matrix(cells.as_buffer(), dim)[order], scale)
                here = own_block == shard
                scores[np.flatnonzero(here), np.argsort(order)[own_at[here]]] = -np.inf if scores.dtype.kind == "f" else LOWEST - 1
                if (block, dim) not in best:
                    best[block, dim] = _Lists(len(query_id), k), own_block << 32 | own_at, query_id.copy()
                best[block, dim][0].add(scores, ids[order], shard, order)
        for lists, query, query_id in best.values():
            q, score, vec_id, shard, at = lists.columns
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (query[q], query_id[q], shard.astype(np.int32), vec_id, at, score)], ["query", "query_id", "shard", "vec_id", "at", "score"])

    lists = left.crossJoin(right).mapInArrow(tile, "query long, query_id long, shard int, vec_id long, at long, score long")
    order = (F.desc("score"), "vec_id", "shard", "at")
    width = FAN_IN
    while width < shards:  # a merge takes lists of at most FAN_IN tiles
        group = F.expr(f"shard div {width}")
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query", group).orderBy(*order))).where(F.col("rank") <= k).drop("rank")
        width *= FAN_IN
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.r, q.vec_id AS query_id, b.vec_id, list_inner_product(q.c, b.c)::BIGINT AS score
  FROM v q JOIN v b ON q.r <> b.r AND len(q.c) = len(b.c) WHERE q.vec_id % 20 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
