"""Approximate vector search over a stored inverted file.

The vectors lie in a table partitioned by cell, the nearest of a few thousand centroids. A search multiplies the query with
the centroids only, picks the nearest cells, and reads just their files. How large a share of the rows must be read for the
recall that is asked for is measured when the index is built, on the sample that the centroids are fitted to: a few cells
where vectors form clusters, much of the table where they lie in all directions alike.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.vectors import nearest_cell, usable_length
from riskloom.operators.vectors import vector_search

#: Vectors that the centroids are fitted to (those with the least md5 of their id), rounds of the fit, and most cells.
SAMPLE, ROUNDS, MAX_CELLS = 16_384, 4, 4_096
#: Recall at NEIGHBOURS that a search is to reach on the mean, and how many sampled vectors are asked to find out.
RECALL, NEIGHBOURS, ASKED = 0.95, 10, 256
#: A search reads this many times k rows at least, if there are so many.
CANDIDATES = 20


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: unit centroids, rows per cell, and the share of rows that reaches the recall it was built for."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    rows: np.ndarray
    share: float

    @property
    def vectors(self) -> DataFrame:
        """The indexed chunks with their cell; cell -1 holds those without a usable vector."""
        return _vectors(self.spark, self.path)


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/columns").schema.add("cell", "integer")
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def _units(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by spherical k-means, begun from the first rows; an empty cell keeps its centroid."""
    centroids = sample[:cells]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def needed_share(sample: np.ndarray, centroids: np.ndarray, recall: float = RECALL) -> float:
    """Share of the rows, nearest cells first, that holds ``recall`` of the nearest neighbours of sampled vectors."""
    asked, k = sample[-ASKED:], min(NEIGHBOURS, len(sample) - 1)
    if k < 1:
        return 1.0
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(sample) - len(asked), len(sample))] = -np.inf
    neighbours = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    cell = (sample @ centroids.T).argmax(1)
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    read = np.cumsum(np.bincount(cell, minlength=len(centroids))[order], axis=1) / len(sample)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), axis=1)
    need = np.take_along_axis(read, np.take_along_axis(place, cell[neighbours], axis=1), axis=1)
    return float(np.quantile(need, recall, method="inverted_cdf"))


def build(chunks: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> VectorIndex:
    """Writes the index of ``chunks`` (id, embedding, any other columns) below ``path`` and opens it.

    Every row is indexed; embeddings of another length than most have no cell of their own (-1) and are never found. The
    number of cells, unless given, is four times the root of the number of vectors, within MAX_CELLS. Cells are written by a
    rebalancing shuffle that splits large ones, so a cell of many equal vectors is many files and not one task.
    """
    spark = chunks.sparkSession
    lengths = (chunks.groupBy(usable_length("embedding").alias("length")).count().filter("length is not null")
               .orderBy(F.desc("count"), "length").limit(1).collect())
    if lengths:
        length, total = lengths[0]["length"], lengths[0]["count"]
        drawn = (chunks.select("id", "embedding").filter(usable_length("embedding") == length)
                 .orderBy(F.md5("id"), "id").limit(sample).select("embedding").toArrow())
        flat = drawn.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        drawn = _units(flat.reshape(-1, length))
        wanted = cells or min(MAX_CELLS, math.ceil(4 * math.sqrt(total)))
        centroids = fit(drawn, min(wanted, len(drawn)))
        share = needed_share(drawn, centroids, recall)
    else:
        centroids, share = np.zeros((1, 1)), 1.0
    fitted = spark.createDataFrame([(i, c.tolist(), share) for i, c in enumerate(centroids)], "cell int, centroid array<double>, share double")
    fitted.coalesce(1).write.parquet(f"{path}/centroids")
    chunks.limit(0).write.parquet(f"{path}/columns")
    add(spark, path, chunks)
    return open_index(spark, path)


def _centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, float]:
    rows = spark.read.schema("cell int, centroid array<double>, share double").parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r.centroid for r in rows]), rows[0].share


def add(spark: SparkSession, path: str, chunks: DataFrame) -> None:
    """Appends ``chunks`` to the cells of a stored index; centroids and share stay."""
    centroids, _ = _centroids(spark, path)
    placed = chunks.withColumn("cell", nearest_cell(centroids)(F.col("embedding")))
    placed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index written at ``path``. Rows per cell come from the files' footers."""
    centroids, share = _centroids(spark, path)
    rows = np.zeros(len(centroids), np.int64)
    for r in _vectors(spark, path).groupBy("cell").count().filter("cell >= 0").collect():
        rows[r["cell"]] = r["count"]
    return VectorIndex(spark, path, centroids, rows, share)


def cells_near(index: VectorIndex, query: Sequence[float], k: int = 10, share: float | None = None) -> list[int]:
    """The nearest cells, as many as hold ``share`` of the rows (what the recall needs, if not given) and CANDIDATES * k."""
    needle = np.asarray(query, np.float64)
    if needle.shape != index.centroids.shape[1:] or not np.isfinite(needle).all() or not needle.any():
        return []
    order = np.argsort(-(index.centroids @ needle), kind="stable")
    before = np.cumsum(index.rows[order]) - index.rows[order]
    wanted = max((index.share if share is None else share) * index.rows.sum(), CANDIDATES * k)
    return [int(c) for c in order[before < wanted] if index.rows[c]]


def search(index: VectorIndex, query: Sequence[float], k: int = 10, share: float | None = None,
           filters: Mapping[str, object] | None = None) -> DataFrame:
    """The k chunks of the nearest cells that are nearest to the query, ranked exactly; only those cells' files are read.

    A query without a direction, or of another length than the index, finds nothing.
    """
    near = index.vectors.filter(F.col("cell").isin(cells_near(index, query, k, share)))
    return vector_search(near, query, k, filters).drop("cell")
