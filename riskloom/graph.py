"""The audit graph as a set of tables: one per node label, one edge table, extractions, chunks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas

Table = DataFrame | Callable[[], DataFrame]


class AuditGraph:
    """Lazily resolved tables of one graph.

    ``edges`` is keyed by relationship type, so a traversal only ever scans the types it
    walks (on disk: the ``rel_type`` partitions it needs). Both ends of an edge exist and
    their labels travel on the edge, so a hop needs no join with the node tables unless it
    reads a node property.
    """

    def __init__(
        self,
        spark: SparkSession,
        nodes: Mapping[str, Table],
        edges: Mapping[str, Table],
        extractions: Table | None = None,
        chunks: Table | None = None,
        unique: Sequence[str] = (),
    ) -> None:
        self.spark = spark
        self._nodes = dict(nodes)
        self._edges = dict(edges)
        self._extractions = extractions
        self._chunks = chunks
        #: Relationship types whose (src, dst, dst_label) repeat in no row, and ``extractions`` if no (document, entity, type) does.
        self.unique = frozenset(unique)
        #: A stored adjacency (``riskloom.operators.adjacency``) that expansions go over, if there is one.
        self.adjacency = None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> AuditGraph:
        """Open a graph written by :meth:`write`."""
        edges = lambda rel: spark.read.schema(schemas.EDGE).parquet(f"{path}/edges").filter(
            F.col("rel_type") == rel)
        return cls(
            spark,
            nodes={
                label: (lambda label=label: spark.read.schema(ddl).parquet(f"{path}/nodes/{label}"))
                for label, ddl in schemas.NODE_SCHEMAS.items()
            },
            edges={rel: (lambda rel=rel: edges(rel)) for rel in schemas.RELATIONSHIP_TYPES},
            extractions=lambda: spark.read.schema(schemas.EXTRACTION).parquet(f"{path}/extractions"),
            chunks=lambda: spark.read.schema(schemas.CHUNK_SCHEMA).parquet(f"{path}/chunks"),
        )

    def write(self, path: str) -> None:
        for label in self._nodes:
            self.node(label).write.mode("overwrite").parquet(f"{path}/nodes/{label}")
        self.edges().write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")
        self.extractions.write.mode("overwrite").parquet(f"{path}/extractions")
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")

    def node(self, label: str) -> DataFrame:
        if label not in schemas.LABELS:
            raise ValueError(f"Unknown label: {label}")
        if label not in self._nodes:
            return self.spark.createDataFrame([], schemas.NODE_SCHEMAS[label])
        table = self._nodes[label]
        if callable(table):
            table = self._nodes[label] = table()
        return table

    def edge(self, rel_type: str, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
        if rel_type not in schemas.RELATIONSHIP_TYPES:
            raise ValueError(f"Unknown relationship type: {rel_type}")
        if rel_type not in self._edges:
            return self.spark.createDataFrame([], schemas.EDGE)
        table = self._edges[rel_type]
        if callable(table):
            table = self._edges[rel_type] = table()
        if src_label:
            table = table.filter(F.col("src_label") == src_label)
        if dst_label:
            table = table.filter(F.col("dst_label") == dst_label)
        return table

    def edges(self, *rel_types: str) -> DataFrame:
        """All edges, or those of the given types."""
        chosen = rel_types or tuple(self._edges)
        return reduce(DataFrame.unionByName, [self.edge(rel) for rel in chosen])

    def entities(self, labels: Sequence[str] | None = None) -> DataFrame:
        """Every node as (id, type, created_at); of the given labels only, if there are any."""
        return reduce(DataFrame.unionByName, [
            self.node(label).select("id", F.lit(label).alias("type"), "created_at")
            for label in (labels or self._nodes)
        ])

    @property
    def extractions(self) -> DataFrame:
        if callable(self._extractions):
            self._extractions = self._extractions()
        return self._extractions

    @property
    def chunks(self) -> DataFrame:
        if callable(self._chunks):
            self._chunks = self._chunks()
        return self._chunks
