"""Record-level changes to the graph tables, each a DataFrame to DataFrame step for a batch of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.graph import AuditGraph
from riskloom.operators.patterns import expand_relationships

PART_CHUNKS = 1000
CHUNK_SEPARATOR = "\n\n---\n\n"


# --- entities ---------------------------------------------------------------------

def provenance_records(entities: DataFrame) -> DataFrame:
    """Extraction rows for entities with an id and their source columns."""
    return entities.select(
        F.concat(F.lit("ext-"), F.substring(F.sha2(F.concat_ws("|", "id", "document_id", F.col("ordinal").cast("string")), 256), 1, 24)).alias("id"),
        F.col("id").alias("entity_id"), "entity_type", F.col("document_id").alias("source_document_id"),
        F.col("model_used").alias("extracted_by"), "extracted_at", "confidence", "section", "page_number",
        F.element_at("line_range", 1).alias("line_range_start"), F.element_at("line_range", 2).alias("line_range_end"))


def entity_with_provenance(graph: AuditGraph, entities: DataFrame) -> DataFrame:
    """(id, extraction fields, line range) per record; a range with a missing or zero end is dropped."""
    both = (F.coalesce("line_range_start", F.lit(0)) != 0) & (F.coalesce("line_range_end", F.lit(0)) != 0)
    records = graph.extractions.select(
        F.col("entity_id").alias("id"), "source_document_id", "extracted_by", "extracted_at", "confidence",
        "section", "page_number",
        F.when(both, F.concat_ws("-", "line_range_start", "line_range_end")).alias("line_range"))
    return entities.select("id").join(records, "id", "left")


def update_entities(nodes: DataFrame, updates: DataFrame, updated_at: str) -> DataFrame:
    """Merges the non-null columns of ``updates`` (by id) and bumps ``updated_at`` of touched rows."""
    changed = [c for c in updates.columns if c != "id"]
    new = updates.select("id", F.lit(True).alias("_touched"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    merged = nodes.join(new, "id", "left")
    touched = F.coalesce("_touched", F.lit(False))
    columns = [
        F.when(touched, F.lit(updated_at).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c) if c == "updated_at"
        else F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
        for c in nodes.columns]
    return merged.select(*columns)


def delete_entities(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_anti")


def detach(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges without those that touch a deleted id at either end."""
    gone = ids.select("id").distinct()
    return (edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))


# --- relationships ------------------------------------------------------------------

def relationship_records(relationships: DataFrame) -> DataFrame:
    """Extraction rows of extracted relationships: one for each, tied to no entity."""
    none = F.lit(None).cast("string")
    return relationships.select(
        relationship_extraction_id().alias("id"), none.alias("entity_id"), none.alias("entity_type"),
        F.col("document_id").alias("source_document_id"), F.col("model_used").alias("extracted_by"), "extracted_at", "confidence",
        "section", "page_number", F.element_at("line_range", 1).alias("line_range_start"), F.element_at("line_range", 2).alias("line_range_end"))


def relationship_extraction_id() -> Column:
    return F.concat(F.lit("ext-"), F.substring(F.sha2(F.concat_ws("|", F.lit("relationship"), "document_id", F.col("ordinal").cast("string")), 256), 1, 24))


def create_relationships(graph: AuditGraph, candidates: DataFrame, src_labels: Sequence[str] | None = None,
                         dst_labels: Sequence[str] | None = None) -> DataFrame:
    """Candidates whose two ends exist, with end labels; the others are dropped.

    ``candidates``: src, dst, rel_type, confidence and, for extracted ones, extraction_id. With the labels that
    the ends may have, only those tables are read.
    """
    end = lambda key, label, labels: graph.entities(labels).select(F.col("id").alias(key), F.col("type").alias(label))
    if "extraction_id" not in candidates.columns:
        candidates = candidates.withColumn("extraction_id", F.lit(None).cast("string"))
    return (candidates.join(end("src", "src_label", src_labels), "src").join(end("dst", "dst_label", dst_labels), "dst")
            .select("src", "dst", "rel_type", "src_label", "dst_label", "confidence", "extraction_id",
                    F.lit("SUGGESTED").alias("status")))


def get_relationships(graph: AuditGraph, ids: DataFrame, direction: str = "both", rel_types: Sequence[str] = ()) -> DataFrame:
    """Edges of the given nodes with true ends, direction, and source section of extracted edges."""
    touching = expand_relationships(graph, ids, rel_types, direction, ["extraction_id"])
    sections = graph.extractions.select(F.col("id").alias("extraction_id"), "section", "page_number")
    return touching.join(sections, "extraction_id", "left").select(
        "id", "src", "dst", "rel_type", "direction", "section", "page_number")


# --- chunks ---------------------------------------------------------------------------

def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_by_document(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return rows.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def migrate_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Copies the chunk table to ``path`` and returns source and copy counts; raises on a mismatch."""
    chunks.write.mode("overwrite").parquet(path)
    copied = chunks.sparkSession.read.parquet(path)
    counts = chunks.agg(F.count(F.lit(1)).alias("source")).withColumn("copied", copied.agg(F.count(F.lit(1))).scalar())
    row = counts.first()
    if row.source != row.copied:
        raise ValueError(f"Chunk copy incomplete: {row.copied} of {row.source}")
    return counts


def rebuild_documents(chunks: DataFrame, part_chunks: int = PART_CHUNKS) -> DataFrame:
    """Document text from its chunks in index order: (document_id, part, chunks, document_type, content).

    Chunk indexes are cut into parts of ``part_chunks``; a document beyond one part is its parts
    in order, joined by the separator. No task ever holds more than one part.
    """
    part = F.floor(F.col("chunk_index") / part_chunks).cast("bigint")
    in_order = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "chunk_text")))
    return (chunks.groupBy("document_id", part.alias("part")).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.max("document_type"), F.lit("generic")).alias("document_type"),
        F.array_join(F.transform(in_order, lambda c: c["chunk_text"]), CHUNK_SEPARATOR).alias("content")))


# --- logs -----------------------------------------------------------------------------

def append(path: str, rows: DataFrame) -> None:
    """Adds rows to a parquet log."""
    rows.write.mode("append").parquet(path)


def save_questions(questions: DataFrame, created_at: str) -> DataFrame:
    """Golden questions in storage form: derived id, facts as JSON text."""
    key = F.concat_ws("|", "document_id", "question", "type")
    return questions.select(
        F.concat(F.lit("gq-"), F.substring(F.sha2(key, 256), 1, 16)).alias("id"), "document_id", "question", "type",
        "source_line_start", "source_line_end", F.to_json("expected_facts").alias("expected_facts"),
        F.lit(created_at).alias("created_at"))


def load_questions(stored: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Stored questions with facts as an array, optionally of some documents only."""
    if documents is not None:
        stored = stored.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return stored.withColumn("expected_facts", F.from_json("expected_facts", "array<string>"))


def latest_runs(runs: DataFrame, by_chunker: bool = False) -> DataFrame:
    """The newest evaluation run per document, or per document and chunker."""
    keys = ["document_id", "chunker_type"] if by_chunker else ["document_id"]
    return runs.groupBy(*keys).agg(
        F.max_by(F.struct("id", "timestamp", "overall_score"), F.struct("timestamp", "id")).alias("r")).select(*keys, "r.*")
