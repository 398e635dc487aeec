"""Stored adjacency: every edge under both of its ends, in buckets of the end, so that a hop shuffles no edges.

The table is partitioned by relationship type and bucketed by (id, slice). A node with very many edges is cut into slices by
its neighbours, and the slices lie in different buckets; whoever stands at such a node goes to all of its slices.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.graph import AuditGraph

#: Edges of a slice and of a bucket.
SLICE_EDGES, BUCKET_EDGES = 1_000_000, 5_000_000


class Adjacency:
    """The table ``name`` of the catalogue, its files below ``path``, and ``hubs``: id and number of slices where there are several."""

    def __init__(self, spark: SparkSession, name: str, path: str) -> None:
        self.spark, self.name, self.path = spark, name, path

    @property
    def hubs(self) -> DataFrame:
        return self.spark.read.schema("id string, slices bigint").parquet(os.path.join(self.path, "hubs"))

    def hops(self, rel_types: Sequence[str] = (), direction: str = "both") -> DataFrame:
        """Edges seen from a node, as :func:`riskloom.operators.patterns.hops` gives them, with their slice."""
        rows = self.spark.table(self.name)
        if rel_types:
            rows = rows.filter(F.col("rel_type").isin(*rel_types))
        return rows if direction == "both" else rows.filter(F.col("direction") == direction)

    def walk(self, at: DataFrame, rel_types: Sequence[str] = (), direction: str = "both") -> DataFrame:
        """The rows of ``at``, which stand at ``id``, with each of its hops; only these rows are shuffled."""
        placed = at.join(self.hubs, "id", "left").withColumn(
            "slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("slices", F.lit(1).cast("bigint")) - 1))).drop("slices")
        return placed.join(self.hops(rel_types, direction), ["id", "slice"]).drop("slice")

    def drop(self) -> None:
        """Takes the table out of the catalogue; its files stay where they were written."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def store(graph: AuditGraph, path: str, buckets: int | None = None, slice_edges: int = SLICE_EDGES) -> Adjacency:
    """Writes the adjacency of all edges of ``graph`` below ``path``; set it as ``graph.adjacency`` to walk over it."""
    both = graph.edges().select("src", "dst", "rel_type", "extraction_id", F.inline(F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("neighbour_id"), F.col("dst_label").alias("neighbour_type"), F.lit("out").alias("direction")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("neighbour_id"), F.col("src_label").alias("neighbour_type"), F.lit("in").alias("direction")))))
    degrees = both.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / slice_edges).alias("slices"))
    degrees.filter("slices > 1").write.parquet(os.path.join(path, "hubs"))
    name = f"adjacency_{uuid.uuid4().hex}"
    adjacency = Adjacency(graph.spark, name, path)
    if buckets is None:
        buckets = max(8, -(-both.count() // BUCKET_EDGES))
    sliced = both.join(adjacency.hubs, "id", "left").withColumn(
        "slice", F.pmod(F.xxhash64("neighbour_id"), F.coalesce("slices", F.lit(1).cast("bigint"))))
    (sliced.select("id", "slice", "neighbour_id", "neighbour_type", "src", "dst", "direction", "extraction_id", "rel_type")
     .repartition(buckets, "id", "slice").write.partitionBy("rel_type").bucketBy(buckets, "id", "slice").sortBy("id", "slice")
     .format("parquet").option("path", os.path.join(path, "edges")).saveAsTable(name))
    return adjacency
