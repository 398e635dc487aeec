"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.graph import AuditGraph
from riskloom.operators import evaluate as ev
from riskloom.operators import vectors as vec
from riskloom.operators.patterns import hops
from riskloom.plans.analytics_catalog import Query, on_graph
from riskloom.session import cut_lineage
from riskloom.sources import ground_truth as gt
from riskloom.sources.star_schema import read_table, read_texts

TOP_K = 5


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per document about two of its lines, with all its sentences as facts; some are deliberately invalid."""
    doc = F.col("doc_id")
    types = F.array(F.lit("factoid"), F.lit("contextual"), F.lit("multi-span"), F.lit("riddle"))
    return read_texts(spark, sf_dir).select(
        doc.alias("question_id"), doc.alias("document_id"),
        F.when(doc % 11 == 5, " short? ").otherwise(F.concat(F.lit("What does it say in document "), doc)).alias("question"),
        F.element_at(types, (doc % 4 + 1).cast("int")).alias("type"),
        (doc % 5 + 1).cast("int").alias("source_line_start"), (doc % 5 + 2).cast("int").alias("source_line_end"),
        F.when(doc % 7 == 6, F.array().cast("array<string>")).otherwise(
            F.filter(F.split("text", r"[.\n]"), lambda x: F.trim(x) != "")).alias("expected_facts"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a chunk."""
    line = (F.col("at") + 1).alias
    return document_lines(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"), F.col("at").alias("chunk_id"), "text", line("line_start"), line("line_end"))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all lines of its document, those that share most words with a question's facts."""
    return ev.retrieve_by_words(line_chunks(spark, sf_dir), golden(spark, sf_dir), TOP_K)


def overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten lines, eight apart, over all documents, that meet their document's source lines."""
    windows = document_lines(spark, sf_dir).filter("at % 8 = 0").select(
        F.col("doc_id").alias("document_id"), F.floor(F.col("at") / 8).alias("chunk_id"), (F.col("at") + 1).alias("line_start"), (F.col("at") + 10).alias("line_end"))
    return ev.relevant_chunks(windows, golden(spark, sf_dir), width=16)


def question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ev.score_questions(retrieved(spark, sf_dir), golden(spark, sf_dir))
    return scores.withColumn("token_iou", F.round("token_iou", 6))


def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = golden(spark, sf_dir)
    scores = ev.score_questions(retrieved(spark, sf_dir), questions).join(questions.select("question_id", "type"), "question_id")
    return _rounded(ev.retrieval_metrics(scores, ["type"]))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk judgements from events; out-of-range scores and unknown labels included."""
    return read_table(spark, sf_dir, "events").select(
        (F.col("event_id") % 50).alias("document_id"), F.when(F.col("event_type") != "view", F.col("value") / 20).alias("concept_unity"),
        (F.col("user_id") % 8).alias("standalone_score"),
        F.when(F.col("event_type") == "error", "mid-sentence").when(F.col("event_type") == "click", "torn")
         .when(F.col("event_type") == "view", "mid-concept").otherwise("clean").alias("boundary_quality"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a fact to be kept."""
    return document_lines(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"), F.col("at").cast("bigint").alias("fact_id"), F.col("text").alias("fact"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts judged against chunks that leave out the lines with a capital E in front."""
    kept = document_lines(spark, sf_dir).filter("text not like 'E%'").select(F.col("doc_id").alias("document_id"), "text")
    return ev.fact_findings(facts(spark, sf_dir), kept)


def preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_texts(spark, sf_dir).select(F.col("doc_id").alias("document_id"))
    return _rounded(ev.preservation(documents, findings(spark, sf_dir)))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evaluation runs per document, their metrics read off the events."""
    e, u = F.col("event_id"), F.col("user_id")
    table = read_table(spark, sf_dir, "events").select(
        F.floor(e / 2).alias("document_id"), F.when(e % 2 == 0, "semantic").otherwise("fixed").alias("chunker_type"),
        (e % 11 / 10).alias("hit_rate_1"), F.least(e % 11 / 10 + 0.1, F.lit(1.0)).alias("hit_rate_3"),
        F.lit(1.0).alias("hit_rate_5"), (u % 9 / 8).alias("mrr"), (1 + u % 5).cast("double").alias("avg_concept_unity"),
        (e % 7 / 8).alias("clean_boundary_rate"), (1 + e % 5).cast("double").alias("avg_standalone_score"),
        (u % 4 / 4).alias("preservation_score"), F.lit(20).alias("questions"), F.lit(8).alias("chunks"),
        F.lit(4).alias("total_facts"), (u % 4).cast("int").alias("facts_found"))
    return ev.with_overall_score(table)


def summary_fields(summaries: DataFrame) -> DataFrame:
    """The summaries with every field read back from the JSON."""
    field = lambda path, kind: F.get_json_object("summary", f"$.{path}").cast(kind).alias(path.split(".")[-1])
    return summaries.select(
        "document_id", "chunker_type", *[F.round(field(f"metrics.{p}", "double"), 6).alias(p.split(".")[-1]) for p in (
            "retrieval.hit_rate_1", "retrieval.hit_rate_3", "retrieval.hit_rate_5", "retrieval.mrr", "intrinsic.avg_concept_unity",
            "intrinsic.clean_boundary_rate", "intrinsic.avg_standalone_score", "preservation", "overall")],
        *[field(f"counts.{p}", "bigint") for p in ("questions", "chunks", "facts")])


def question_vectors(graph: AuditGraph) -> dict[int, list[float]]:
    """Stored embeddings stand in for the twenty embedded questions."""
    ids = {f"chk-{row[0]}": row[0] for row in gt.GROUND_TRUTH}
    rows = graph.chunks.filter(F.col("id").isin(*ids)).select("id", "embedding").collect()  # twenty rows
    return {ids[r.id]: list(r.embedding) for r in sorted(rows, key=lambda r: ids[r.id])}


def question_hits(graph: AuditGraph) -> DataFrame:
    """(question_id, graph_node_id, text) of the chunks found for the twenty questions."""
    hits = vec.search_many(graph.chunks, question_vectors(graph), TOP_K).select("question_id", F.col("chunk_id").alias("id"))
    return cut_lineage(hits.join(graph.chunks.select("id", "graph_node_id", F.col("chunk_text").alias("text")), "id"))


def retrieved_entities(graph: AuditGraph, hits: DataFrame) -> DataFrame:
    """Owners of each question's nearest chunks and their direct neighbours.

    The owners are few, TOP_K a question at most: as values they reach the scans, below the steps that make edges distinct.
    """
    owners = hits.select("question_id", F.col("graph_node_id").alias("id")).distinct()
    ids = [r.id for r in owners.filter("id is not null").select("id").distinct().collect()]
    near = owners.join(hops(graph, ids=ids).select("id", "neighbour_id"), "id").select("question_id", F.col("neighbour_id").alias("id"))
    return owners.unionByName(near).distinct()


def entity_scores(graph: AuditGraph, hits: DataFrame | None = None) -> DataFrame:
    found = retrieved_entities(graph, question_hits(graph) if hits is None else hits)
    return _rounded(ev.entity_scores(gt.questions(graph.spark), ev.expected_entities(graph), found))


def coverage_scores(graph: AuditGraph, hits: DataFrame | None = None) -> DataFrame:
    """Coverage of the twenty questions, with frequent letter groups added to their keywords."""
    extra = gt.questions(graph.spark).select("question_id", F.explode(F.array(*[F.lit(k) for k in ("THE", "ción", "eau", "der")])).alias("keyword"))
    return _rounded(ev.keyword_coverage(gt.keywords(graph.spark).unionByName(extra), question_hits(graph) if hits is None else hits))


def summary(graph: AuditGraph) -> DataFrame:
    hits = question_hits(graph)
    return ev.category_means(entity_scores(graph, hits).join(coverage_scores(graph, hits), "question_id"))


QUERIES: dict[str, Query] = {
    "e01_valid_questions": lambda s, d: ev.valid_questions(golden(s, d), read_texts(s, d).select(
        F.col("doc_id").alias("document_id"), F.size(F.split("text", "\n")).alias("line_count"))).select(
        "question_id", "type", F.size("expected_facts").cast("bigint").alias("facts")),
    "e02_relevance": lambda s, d: ev.relevance(retrieved(s, d), golden(s, d)).select(
        "question_id", F.col("rank").cast("bigint").alias("rank"), "relevant"),
    "j08_range_overlaps": overlapping_windows,
    "e03_first_relevant": lambda s, d: ev.first_relevant(retrieved(s, d), golden(s, d)),
    "e04_token_overlap": lambda s, d: _rounded(ev.token_overlap(retrieved(s, d), golden(s, d))),
    "e05_question_scores": question_scores,
    "e05_retrieval_metrics": lambda s, d: _rounded(ev.retrieval_metrics(question_scores(s, d))),
    "e05_retrieval_metrics_by_type": metrics_by_type,
    "e06_intrinsic_metrics": lambda s, d: _rounded(ev.intrinsic_metrics(judgements(s, d), ["document_id"]), 8),
    "e07_preservation": preserved,
    "e07_missing_facts": lambda s, d: ev.missing_facts(findings(s, d)),
    "e08_overall_score": lambda s, d: runs(s, d).select("document_id", "chunker_type", "overall_score"),
    "e09_compare_runs": lambda s, d: ev.compare_runs(runs(s, d)),
    "e10_run_insights": lambda s, d: ev.run_insights(runs(s, d)).withColumn("value", F.round("value", 6)),
    "e10_comparison_insights": lambda s, d: ev.comparison_insights(ev.compare_runs(runs(s, d))),
    "e10_score_bands": lambda s, d: runs(s, d).groupBy(ev.score_band(F.col("overall_score")).alias("band")).agg(F.count(F.lit(1)).alias("runs")),
    "e11_run_summaries": lambda s, d: summary_fields(ev.run_summaries(runs(s, d))),
    "e12_entity_scores": on_graph(entity_scores),
    "e13_keyword_coverage": on_graph(coverage_scores),
    "e14_category_means": on_graph(summary),
    "e15_distribution_check": on_graph(lambda g: ev.distribution_check(
        g.node("Control"), "control_type", {**gt.EXPECTED_DISTRIBUTION[19], "PREVENTIVE": 34, "DETECTIVE": 1})),
}
