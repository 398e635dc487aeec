"""Vector search over chunk embeddings, alone and with graph context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.filters import matches
from riskloom.functions.rounding import round_half_up
from riskloom.functions.vectors import cosine, cosine_to, cosine_to_many
from riskloom.graph import AuditGraph
from riskloom.operators.patterns import chunks_of, expand_relationships, reachable
from riskloom.session import cut_lineage

MAX_QUERIES = 1000


def vector_search(chunks: DataFrame, query: Sequence[float], k: int = 10,
                  filters: Mapping[str, object] | None = None) -> DataFrame:
    """The k chunks nearest to the query vector. Filters apply before ranking, so k rows come
    back whenever that many chunks match."""
    scored = chunks.filter(matches(filters)).withColumn("score", cosine_to(query)(F.col("embedding")))
    return scored.filter("score is not null").orderBy(F.desc("score"), "id").limit(k)


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int = 5,
                   on: Sequence[str] = ("document_id",)) -> DataFrame:
    """For every question its k nearest chunks among those of the same document.

    ``questions``: question_id, embedding and the ``on`` columns. A plain equi join, so a document
    with many chunks is split like any skewed join; Spark keeps the k best per question before the
    ranking shuffle (window group limit).
    """
    asked = questions.select("question_id", *on, F.col("embedding").alias("question_embedding"))
    pairs = asked.join(chunks.select(F.col("id").alias("chunk_id"), *on, "embedding"), list(on))
    scored = pairs.select("question_id", "chunk_id",
                          cosine(F.col("question_embedding"), F.col("embedding")).alias("score"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return (scored.filter("score is not null").withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= k))


def search_many(chunks: DataFrame, queries: Mapping[int, Sequence[float]], k: int = 5) -> DataFrame:
    """The k nearest chunks for each of a bounded set of query vectors, in one pass over the chunks.

    Every batch of embeddings is multiplied with the query matrix; only k rows per query and
    partition go on to the ranking.
    """
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"At most {MAX_QUERIES} query vectors per pass, got {len(queries)}; use nearest_chunks")
    ids = F.array(*[F.lit(q) for q in queries])
    scores = cosine_to_many(list(queries.values()))(F.col("embedding"))
    scored = chunks.select(F.col("id").alias("chunk_id"), F.posexplode(scores).alias("at", "score")).select(
        F.get(ids, F.col("at")).alias("question_id"), "chunk_id", "score")
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return (scored.filter("score is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))


def count_by_filter(chunks: DataFrame, filters: Mapping[str, object] | None = None) -> DataFrame:
    return chunks.filter(matches(filters)).agg(F.count(F.lit(1)).alias("chunks"))


def semantic_search(graph: AuditGraph, query: Sequence[float], k: int = 10, depth: int = 1,
                    filters: Mapping[str, object] | None = None) -> DataFrame:
    """Top-k chunks with the owning entity and the entities within ``depth`` hops of it.

    One row per (chunk, related entity); a chunk without owner or neighbours keeps one row.
    """
    hits = vector_search(graph.chunks, query, k, filters).select(
        F.col("id").alias("chunk_id"), "graph_node_id", "score",
        F.coalesce("semantic_type", F.lit("unknown")).alias("semantic_type"), F.coalesce("context", F.lit("")).alias("context"))
    owners = graph.entities().select(F.col("id").alias("entity_id"), F.col("type").alias("entity_type"))
    # k rows, read again by every hop of the expansion.
    hits = cut_lineage(hits.join(owners, F.col("graph_node_id") == F.col("entity_id"), "left"))
    related = reachable(graph, hits.filter("entity_id is not null").select(F.col("entity_id").alias("id")), depth)
    related = related.select(F.col("seed_id").alias("entity_id"), F.col("id").alias("related_id"),
                             F.col("type").alias("related_type"), "depth").filter("entity_id <> related_id")
    return hits.join(related, "entity_id", "left").select(
        "chunk_id", F.round("score", 6).alias("score"), "semantic_type", "context", "entity_id", "entity_type",
        "related_id", "related_type", "depth")


def search_aggregations(results: DataFrame) -> DataFrame:
    """Totals of a semantic search: chunks, distinct entities, chunks per semantic type."""
    chunks = results.select("chunk_id", "entity_id", "semantic_type").distinct()
    rows = chunks.select("chunk_id", "entity_id", F.explode(F.array(
        F.lit("total"), F.concat(F.lit("type:"), "semantic_type"))).alias("metric"))
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("chunks"),
                                      F.count_distinct("entity_id").alias("entities"))


def entity_context(graph: AuditGraph, entity_ids: DataFrame, max_chunks: int | None = None,
                   include_relationships: bool = False) -> DataFrame:
    """Chunks (all, or the first ``max_chunks`` by index), relationships and first provenance of entities.

    Rows: (entity_id, part, item_id, detail, confidence); part is 'provenance', 'chunk' or a
    relationship direction.
    """
    none = F.lit(None).cast("string")
    wanted = graph.entities().join(entity_ids.select("id").distinct(), "id", "left_semi").select("id")
    found = chunks_of(graph, wanted)
    if max_chunks is not None:
        by_index = Window.partitionBy("graph_node_id").orderBy("chunk_index", "id")
        found = found.withColumn("n", F.row_number().over(by_index)).filter(F.col("n") <= max_chunks)
    chunks = (found
              .select(F.col("graph_node_id").alias("entity_id"), F.lit("chunk").alias("part"),
                      F.col("id").alias("item_id"), F.coalesce("context", F.lit("")).alias("detail"),
                      F.lit(None).cast("double").alias("confidence")))
    first = (graph.extractions.groupBy(F.col("entity_id").alias("id"))
             .agg(F.min_by(F.struct("source_document_id", "confidence"), F.struct("extracted_at", "id")).alias("p")))
    provenance = wanted.join(first, "id", "left").select(
        F.col("id").alias("entity_id"), F.lit("provenance").alias("part"), F.col("p.source_document_id").alias("item_id"),
        none.alias("detail"), F.coalesce(F.nullif(F.col("p.confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    out = provenance.unionByName(chunks)
    if include_relationships:
        out = out.unionByName(expand_relationships(graph, wanted).select(
            F.col("id").alias("entity_id"), F.col("direction").alias("part"), F.col("neighbour_id").alias("item_id"),
            F.col("rel_type").alias("detail"), F.lit(None).cast("double").alias("confidence")))
    return out


def chunk_statistics(chunks: DataFrame, group_by: str = "semantic_type") -> DataFrame:
    """Chunks, mean tokens and oversized chunks per semantic type, context or document, and overall."""
    if group_by not in ("semantic_type", "context", "document_id"):
        raise ValueError(f"Cannot group chunks by {group_by}")
    tokens = F.coalesce("tokens", F.lit(0))
    grouped = chunks.withColumn("group", F.coalesce(F.col(group_by), F.lit("unknown"))).rollup("group").agg(
        F.grouping("group").alias("overall"), F.count(F.lit(1)).alias("chunks"), F.avg(tokens).alias("mean"),
        F.sum(F.when(F.col("is_oversized"), 1).otherwise(0)).alias("oversized"))
    return grouped.select(
        F.when(F.col("overall") == 1, "TOTAL").otherwise(F.col("group")).alias("group"), "chunks",
        F.when(F.col("overall") == 1, round_half_up(F.col("mean"), 0)).otherwise(F.round("mean", 6)).alias("avg_tokens"),
        "oversized")
