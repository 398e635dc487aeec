"""A stored graph that grows by batches: ingestion that ends in nodes, edges, extraction records and chunks of a table each.

Every batch writes its rows of every table under its own ``batch_id`` and, when all are there, one manifest. Readers see the
rows of batches with a manifest only, so a batch appears whole or not at all; what an attempt that failed has left is
overwritten by the next attempt under the same id. Batches are committed one after the other, by one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.graph import AuditGraph
from riskloom.operators import ingest as ing
from riskloom.operators import records as rec
from riskloom.session import cut_lineage

EDGE = "src string, dst string, rel_type string, src_label string, dst_label string, confidence double, extraction_id string, status string, properties map<string,string>"
VERSION = "id string, entity_type string, business_key string, fingerprint string"
SEEN = "document_id string, ordinal int, entity_id string"
LOG = ("document_id string, model string, timestamp timestamp_ntz, tokens_used bigint, confidence_avg double, entity_count bigint, "
       "relationship_count bigint, status string, error_message string")
MANIFEST = "sequence int, tables array<string>, counts string"
BATCH = "batch_id string, batch int"


def property_name(column: str) -> str:
    """``control_type`` is extracted as ``controlType``."""
    head, *tail = column.split("_")
    return head + "".join(t.capitalize() for t in tail)


def typed_nodes(entities: DataFrame, label: str) -> DataFrame:
    """Entities of a label with the columns of its node table; a value that does not fit its type is null."""
    columns = [part.strip().split() for part in schemas.NODE_SCHEMAS[label].split(",")]
    kept = {"id", "created_at", "updated_at"}
    return entities.filter(F.col("entity_type") == label).select(*[
        F.col(name) if name in kept else F.col("properties")[property_name(name)].try_cast(kind).alias(name) for name, kind in columns])


class GraphStore:
    """The graph below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.refresh()

    # --- batches ----------------------------------------------------------------------

    def refresh(self) -> None:
        """Takes notice of batches that others have committed."""
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, batch_id string").json(f"{self.path}/manifest").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            rows = []
        self._batches = sorted(((r.batch_id, r.sequence, json.loads(r.counts)) for r in rows), key=lambda b: b[1])

    def batches(self) -> list[tuple[str, int, dict[str, int]]]:
        """Committed batches in order: id, sequence number, rows written per table."""
        return self._batches

    def _write(self, batch_id: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy("rel_type") if name == "edges" else writer).parquet(f"{self.path}/{name}/batch_id={batch_id}")
        # Counted from the footers of what was written; tables without rows are left out of the manifest.
        written = [self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/batch_id={batch_id}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
                   for name, df in tables.items()]
        counts = {r.name: r.n for r in reduce(DataFrame.unionByName, written).collect() if r.n or r.name == "purged"}
        self._commit(batch_id, counts)

    def _commit(self, batch_id: str, counts: dict[str, int]) -> None:
        row = (max((b[1] for b in self.batches()), default=-1) + 1, list(counts), json.dumps(counts))
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/batch_id={batch_id}")
        self.refresh()

    def table(self, name: str, schema: str) -> DataFrame:
        """Committed rows of a table, with ``batch``, the sequence number of the batch that wrote them."""
        holds = [(b, n) for b, n, counts in self.batches() if name in counts]
        if not holds:
            return self.spark.createDataFrame([], f"{schema}, batch int").filter(F.lit(False))  # joins with no rows are left out of plans
        number = F.create_map(*[F.lit(x) for pair in holds for x in pair])
        rows = self.spark.read.schema(f"{schema}, batch_id string").parquet(f"{self.path}/{name}").filter(F.col("batch_id").isin([b for b, _ in holds]))
        return rows.withColumn("batch", number[F.col("batch_id")]).drop("batch_id")

    # --- reading ----------------------------------------------------------------------

    def _standing(self, rows: DataFrame, *ends: str) -> DataFrame:
        """Rows that no later purge has touched."""
        if not any("purged" in counts for _, _, counts in self.batches()):
            return rows
        purged = self.table("purged", "id string").groupBy("id").agg(F.max("batch").alias("purged_by"))
        for end in ends:
            gone = purged.select(F.col("id").alias(end), "purged_by")
            rows = rows.join(gone, end, "left").filter("purged_by IS NULL OR batch > purged_by").drop("purged_by")
        return rows

    def node(self, label: str) -> DataFrame:
        """Nodes of a label; of a document that several batches have written, the last row."""
        rows = self._standing(self.table(f"nodes/{label}", schemas.NODE_SCHEMAS[label]), "id")
        if label != "Document":
            return rows.drop("batch")
        columns = [c for c in rows.columns if c not in ("id", "batch")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "batch").alias("last")).select("id", "last.*")

    def graph(self) -> AuditGraph:
        """The committed graph; edges keep their properties in one more column."""
        edges = lambda rel: self._standing(self.table("edges", EDGE).filter(F.col("rel_type") == rel), "src", "dst").drop("batch").select(
            *schemas.EDGE.names, "properties")
        return AuditGraph(
            self.spark,
            nodes={label: (lambda label=label: self.node(label)) for label in schemas.LABELS},
            edges={rel: (lambda rel=rel: edges(rel)) for rel in schemas.RELATIONSHIP_TYPES},
            extractions=lambda: self._standing(self.table("extractions", _ddl(schemas.EXTRACTION)), "source_document_id").drop("batch").select(*schemas.EXTRACTION.names),
            chunks=lambda: self._standing(self.table("chunks", schemas.CHUNK_SCHEMA), "document_id").drop("batch"))

    def log(self) -> DataFrame:
        return self.table("log", LOG).drop("batch")

    # --- writing ----------------------------------------------------------------------

    def _versions(self) -> DataFrame:
        superseded = self.table("edges", EDGE).filter("rel_type = 'SUPERSEDES'").select(F.col("dst").alias("id")).distinct()
        return (self.table("versions", VERSION).drop("batch").join(superseded.withColumn("old", F.lit(True)), "id", "left")
                .select("id", "entity_type", "business_key", "fingerprint", F.col("old").isNull().alias("is_latest")))

    def _fresh(self, batch_id: str) -> bool:
        self.refresh()
        return all(b != batch_id for b, _, _ in self._batches)

    def ingest(self, batch_id: str, raw: DataFrame, documents: DataFrame | None = None, chunks: DataFrame | None = None) -> bool:
        """Commits one batch of extraction responses; False, without a change, if ``batch_id`` is committed already.

        ``raw`` is what :mod:`riskloom.operators.ingest` takes; ``documents`` may give more columns of the Document nodes by
        ``id``, ``chunks`` the rows of the chunk table (of documents that fail, none are taken). Documents that fail a check
        become FAILED nodes and nothing else. Documents that an earlier batch holds add neither versions, edges nor records,
        so the same responses under another batch id change nothing but the log.

        Entities, edges and records carry the ids of their documents: only if the store names a document of the batch are they
        looked up there, and if it names all that the documents bring, nothing is resolved.
        """
        if not self._fresh(batch_id):
            return False
        raw = cut_lineage(ing.judged(raw))
        passed = raw.filter("valid")
        tables = {"log": ing.extraction_log(raw), "nodes/Document": self._documents(raw, documents)}
        seen = self.table("seen", SEEN).drop("batch")
        held = seen.select(F.col("document_id").alias("held_id"))
        again = not passed.select("document_id").join(held, F.col("document_id").eqNullSafe(F.col("held_id")), "left_semi").isEmpty()
        if not again or self._brings_more(passed, seen):
            tables |= self._resolved_tables(passed, seen if again else seen.filter(F.lit(False)), again)
        if chunks is not None:
            had = self.table("chunks", schemas.CHUNK_SCHEMA).select("document_id").distinct()
            tables["chunks"] = chunks.join(passed.select("document_id"), "document_id", "left_semi").join(had, "document_id", "left_anti").select(
                *[c.split()[0] for c in schemas.CHUNK_SCHEMA.split(", ")])
        self._write(batch_id, tables)
        return True

    def _brings_more(self, passed: DataFrame, seen: DataFrame) -> bool:
        """Whether an entity or relationship of these documents is not in the store."""
        entities = ing.parse_entities(passed).select("document_id", "ordinal").join(seen, ["document_id", "ordinal"], "left_anti")
        relationships = ing.between_entities(ing.parse_relationships(passed)).select(rec.relationship_extraction_id().alias("known_id"))
        return not (entities.isEmpty() and relationships.join(self._known_extractions(), "known_id", "left_anti").isEmpty())

    def _resolved_tables(self, passed: DataFrame, seen: DataFrame, again: bool) -> dict[str, DataFrame]:
        """What documents that passed add to the graph; ``again`` if the store names some of them."""
        # Whatever has a version of its own in the store is named in ``seen``, so what is new needs no second look at the store.
        resolved = cut_lineage(ing.resolve_entities(ing.parse_entities(passed), self._versions(), seen))
        new, made = resolved.filter("NOT repeated"), ing.to_entities(resolved)
        references = ing.entity_references(resolved)
        linked = ing.resolve_relationships(ing.parse_relationships(passed), references)
        if again:
            linked = linked.join(self._known_extractions(), rec.relationship_extraction_id() == F.col("known_id"), "left_anti")
        linked = cut_lineage(linked)
        tables = {
            "edges": self._new_edges(resolved, references, linked, again),
            "extractions": rec.provenance_records(_as_records(new)).unionByName(rec.relationship_records(linked)),
            "versions": resolved.filter("action <> 'found_identical'").select(F.col("entity_id").alias("id"), "entity_type", "business_key", "fingerprint"),
            "seen": new.select("document_id", "ordinal", "entity_id"),
        }
        labels = [r.entity_type for r in resolved.select("entity_type").distinct().collect()]  # ten at most
        return tables | {f"nodes/{label}": typed_nodes(made, label) for label in labels}

    def _known_extractions(self) -> DataFrame:
        return self.table("extractions", _ddl(schemas.EXTRACTION)).filter("entity_id IS NULL").select(F.col("id").alias("known_id"))

    def _new_edges(self, resolved: DataFrame, references: DataFrame, linked: DataFrame, again: bool) -> DataFrame:
        """Extracted edges, one for each extraction, and implicit and version edges that are not there yet."""
        none = F.lit(None).cast("string")
        extracted = linked.select("src", "dst", "rel_type", "src_label", "dst_label", "confidence",
                                  rec.relationship_extraction_id().alias("extraction_id"), F.lit("SUGGESTED").alias("status"), "properties")

        implicit = ing.implicit_edges(references).select("src", "dst", "rel_type", F.lit("Document").alias("label"))
        versions = resolved.filter("supersedes_id IS NOT NULL").select(
            F.col("entity_id").alias("src"), F.col("supersedes_id").alias("dst"), F.lit("SUPERSEDES").alias("rel_type"), F.col("entity_type").alias("label"))
        stored = self.table("edges", EDGE).filter("extraction_id IS NULL").select("src", "dst", "rel_type")
        created = implicit.unionByName(versions).distinct()
        if again:
            created = created.join(stored, ["src", "dst", "rel_type"], "left_anti")
        uses, identifies = F.col("rel_type") == "USES", F.col("rel_type") == "IDENTIFIES"
        reason = F.create_map(F.lit("reason"), F.lit("Property changes detected"))
        return extracted.unionByName(created.select(
            "src", "dst", "rel_type", F.when(uses, "Audit").otherwise(F.col("label")).alias("src_label"),
            F.when(identifies, "FailureMode").otherwise(F.col("label")).alias("dst_label"), F.lit(1.0).alias("confidence"), none.alias("extraction_id"),
            F.lit("CONFIRMED").alias("status"), F.when(~uses & ~identifies, reason).alias("properties")))

    def _documents(self, raw: DataFrame, documents: DataFrame | None) -> DataFrame:
        status = ing.judged_status(raw)
        names = [part.split()[0] for part in schemas.NODE_SCHEMAS["Document"].split(", ")]
        own = {"id": F.col("document_id"), "created_at": F.col("extracted_at"), "updated_at": F.col("extracted_at"),
               "status": F.col("s.status"), "error": F.col("s.error"), "uploaded_at": F.col("extracted_at")}
        rows, given = status.alias("s"), set()
        if documents is not None:
            given = set(documents.columns) - {"id", "status", "error"}
            rows = rows.join(documents.select(F.col("id").alias("given_id"), *given).alias("d"), F.col("document_id") == F.col("given_id"), "left")
        fresh = rows.select(*[F.coalesce(F.col(f"d.{n}"), own[n]).alias(n) if n in given and n in own else F.col(f"d.{n}").alias(n) if n in given
                              else own.get(n, F.lit(None).cast("string")).alias(n) for n in names])
        kept = self.node("Document").filter("status = 'PROCESSED'").select("id")
        return fresh.join(kept, "id", "left_anti")

    def purge(self, batch_id: str, as_of: str, older_than_hours: int = 24) -> int:
        """Deletes long failed documents with their edges, as a batch of its own; returns how many. A repeated batch deletes none."""
        if not self._fresh(batch_id):
            return 0
        self._write(batch_id, {"purged": ing.purge_failed(self.node("Document"), as_of, older_than_hours)})
        return self.batches()[-1][2]["purged"]


def _as_records(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("id", F.col("entity_id"))


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def graph_rows(graph: AuditGraph, labels: Sequence[str] = schemas.LABELS) -> DataFrame:
    """A graph as rows (part, id, type, other_id, detail): nodes, edges and extraction records."""
    none = F.lit(None).cast("string")

    def described(label: str) -> DataFrame:
        node = graph.node(label)
        detail = F.coalesce(*[F.col(c).cast("string") for c in ("status", "code", "level", "control_type", "audit_date", "description", "name") if c in node.columns])
        return node.select(F.lit("node").alias("part"), "id", F.lit(label).alias("type"), none.alias("other_id"), detail.alias("detail"))

    edges = graph.edges()
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e.key, e.value)), ";")
    out = edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("rel_type").alias("type"), F.col("dst").alias("other_id"),
                       F.concat_ws("|", "src_label", "dst_label", "status", "extraction_id", entries).alias("detail"))
    records = graph.extractions.select(
        F.lit("extraction").alias("part"), "id", F.col("entity_type").alias("type"), F.col("source_document_id").alias("other_id"),
        F.concat_ws("|", "entity_id", "extracted_by", "section", "page_number", "line_range_start", "line_range_end").alias("detail"))
    for part in (records, *map(described, labels)):
        out = out.unionByName(part)
    return out
