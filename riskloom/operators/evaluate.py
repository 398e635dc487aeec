"""Retrieval and chunking evaluation over tables of questions, retrieved chunks and judgements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.filters import matches
from riskloom.functions.intervals import overlapping
from riskloom.functions.rounding import ratio, round_half_up
from riskloom.graph import AuditGraph
from riskloom.operators.patterns import edge_ends, related_ids
from riskloom.sources.ground_truth import GROUND_TRUTH

QUESTION_TYPES = ("factoid", "contextual", "multi-span")
BOUNDARIES = ("clean", "mid-sentence", "mid-concept")
WEIGHTS = {"retrieval": 0.5, "intrinsic": 0.3, "preservation": 0.2}
TIE = 0.02
OVERALL = "OVERALL"


# --- golden questions ------------------------------------------------------------------------------

def valid_questions(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Questions that are long enough, of a known type, inside their document and with facts.

    ``documents``: document_id, line_count.
    """
    return questions.join(documents.select("document_id", "line_count"), "document_id").filter(
        (F.length(F.trim(F.coalesce("question", F.lit("")))) >= 10) & F.col("type").isin(*QUESTION_TYPES)
        & (F.col("source_line_start") >= 1) & (F.col("source_line_end") <= F.col("line_count"))
        & (F.col("source_line_start") <= F.col("source_line_end"))
        & (F.coalesce(F.size("expected_facts"), F.lit(0)) > 0)).drop("line_count")


# --- retrieval -----------------------------------------------------------------------------------------

def relevance(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Marks retrieved chunks whose line range meets the range the question was drawn from."""
    ranges = questions.select("question_id", "source_line_start", "source_line_end")
    overlaps = (F.col("line_start") <= F.col("source_line_end")) & (F.col("source_line_start") <= F.col("line_end"))
    return results.join(ranges, "question_id").withColumn("relevant", F.coalesce(overlaps, F.lit(False)))


def relevant_chunks(chunks: DataFrame, questions: DataFrame, width: int = 64) -> DataFrame:
    """(question_id, chunk_id): all chunks of a question's document, retrieved or not, whose lines meet its source lines."""
    ranges = questions.select("question_id", "document_id", "source_line_start", "source_line_end")
    found = overlapping(chunks.select("document_id", "chunk_id", "line_start", "line_end"), ranges, ["document_id"],
                        ("line_start", "line_end"), ("source_line_start", "source_line_end"), width)
    return found.select("question_id", "chunk_id")


def retrieve_by_words(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """The k chunks of a question's document that share most distinct words with its facts, and their rank.

    ``chunks``: document_id, chunk_id, text and any other columns. All chunks of a document compete; a chunk that shares no
    word is not retrieved, ties go to the lower chunk_id. Words meet by (document, word), texts join the k winners only.
    """
    # Dealt once, as the join needs it; repeated questions are made one where they already lie.
    facts = questions.select("question_id", "document_id", F.explode(_fact_words()).alias("word")).repartition("document_id", "word").distinct()
    found = chunks.select("document_id", "chunk_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    shared = facts.join(found, ["document_id", "word"]).groupBy("question_id", "document_id", "chunk_id").agg(F.count(F.lit(1)).alias("shared"))
    best = Window.partitionBy("question_id").orderBy(F.desc("shared"), "chunk_id")
    ranked = shared.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(chunks, ["document_id", "chunk_id"])


def first_relevant(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, rank of the first relevant chunk or null, hit) for every question."""
    ranks = (relevance(results, questions).filter("relevant").groupBy("question_id")
             .agg(F.min("rank").cast("bigint").alias("first_rank")))
    return questions.select("question_id").join(ranks, "question_id", "left").withColumn("hit", F.col("first_rank").isNotNull())


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2)


def _fact_words() -> Column:
    """The distinct words of a question's facts."""
    return F.array_distinct(_words(F.array_join("expected_facts", " ")))


def token_overlap(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Shared over all distinct words of a question's facts and its retrieved chunks; 0 without fact words.

    A question's facts are one value as they come, and stay so: its distinct words meet those of its retrieved chunks, of
    which there are as many as were asked for, in one row instead of a row a word.
    """
    found = (results.select("question_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
             .groupBy("question_id").agg(F.collect_set("word").alias("found")))
    rows = questions.select("question_id", F.coalesce(_fact_words(), F.array().cast("array<string>")).alias("facts")).join(found, "question_id", "left")
    rows = rows.withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    rows = rows.withColumn("shared", F.size(F.array_intersect("facts", "found")))
    iou = F.when(F.size("facts") > 0, F.col("shared") / (F.size("facts") + F.size("found") - F.col("shared"))).otherwise(0.0)
    return rows.select("question_id", iou.alias("token_iou"))


def score_questions(results: DataFrame, questions: DataFrame) -> DataFrame:
    return first_relevant(results, questions).join(token_overlap(results, questions), "question_id")


def retrieval_metrics(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hit rates at 1, 3 and 5, mean reciprocal rank and mean token overlap."""
    within = lambda k: F.coalesce(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0))
    return scores.groupBy(*by).agg(
        within(1).alias("hit_rate_1"), within(3).alias("hit_rate_3"), within(5).alias("hit_rate_5"),
        F.coalesce(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg("token_iou"), F.lit(0.0)).alias("avg_token_iou"), F.count(F.lit(1)).alias("questions"))


# --- chunk quality ----------------------------------------------------------------------------------------

def cleaned_judgements(evaluations: DataFrame) -> DataFrame:
    """Scores clamped to 1..5 (3 when missing), unknown boundary labels read as clean."""
    score = lambda c: F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(F.col(c).cast("double"), F.lit(3.0)))).alias(c)
    boundary = F.when(F.col("boundary_quality").isin(*BOUNDARIES), F.col("boundary_quality")).otherwise("clean")
    rest = [c for c in evaluations.columns if c not in ("concept_unity", "standalone_score", "boundary_quality")]
    return evaluations.select(*rest, score("concept_unity"), score("standalone_score"), boundary.alias("boundary_quality"))


def intrinsic_metrics(evaluations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    clean = F.when(F.col("boundary_quality") == "clean", 1.0).otherwise(0.0)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return cleaned_judgements(evaluations).groupBy(*by).agg(
        mean("concept_unity").alias("avg_concept_unity"), mean(clean).alias("clean_boundary_rate"),
        mean("standalone_score").alias("avg_standalone_score"), F.count(F.lit(1)).alias("chunks"))


def fact_findings(facts: DataFrame, chunks: DataFrame, min_share: float = 1.0) -> DataFrame:
    """Whether each fact's words occur in its document's chunks: (document_id, fact_id, fact, found).

    ``min_share`` of the words (longer than two characters) must occur. Both sides are distinct
    (document, word) rows, so no fact is ever paired with a chunk.
    """
    words = facts.select("document_id", "fact_id", F.explode(F.array_distinct(_words(F.col("fact")))).alias("word"))
    present = chunks.select("document_id", F.explode(_words(F.col("text"))).alias("word")).distinct().withColumn("present", F.lit(1))
    shares = words.join(present, ["document_id", "word"], "left").groupBy("document_id", "fact_id").agg(
        (F.count("present") / F.count(F.lit(1))).alias("share"))
    return facts.select("document_id", "fact_id", "fact").join(shares, ["document_id", "fact_id"], "left").select(
        "document_id", "fact_id", "fact", (F.coalesce("share", F.lit(0.0)) >= min_share).alias("found"))


def preservation(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Facts found over all facts per document; 1 for a document without facts."""
    counts = findings.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_facts"), F.sum(F.col("found").cast("int")).alias("facts_found"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return documents.select("document_id").join(counts, "document_id", "left").select(
        "document_id", zero("total_facts").alias("total_facts"), zero("facts_found").alias("facts_found"),
        ratio(F.col("facts_found"), F.col("total_facts"), empty=1.0).alias("preservation_score"))


def missing_facts(findings: DataFrame) -> DataFrame:
    return findings.filter("not found").select("document_id", "fact_id", "fact")


# --- scores and comparison --------------------------------------------------------------------------------

def with_overall_score(runs: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Weighted score of a run from its metric columns, three decimals."""
    retrieval = F.col("hit_rate_1") * 0.3 + F.col("hit_rate_3") * 0.3 + F.col("mrr") * 0.4
    intrinsic = (F.col("avg_concept_unity") / 5 * 0.4 + F.col("clean_boundary_rate") * 0.3
                 + F.col("avg_standalone_score") / 5 * 0.3)
    return runs.withColumn("overall_score", round_half_up(
        retrieval * weights["retrieval"] + intrinsic * weights["intrinsic"] + F.col("preservation_score") * weights["preservation"], 3))


def compare_runs(runs: DataFrame) -> DataFrame:
    """Semantic against fixed run of each document: deltas and winner (a tie within 0.02)."""
    side = lambda name: runs.filter(F.col("chunker_type") == name).select(
        "document_id", *[F.col(c).alias(f"{name}_{c}") for c in ("mrr", "avg_concept_unity", "preservation_score", "overall_score")])
    pairs = side("semantic").join(side("fixed"), "document_id")
    delta = lambda a, b: round_half_up(a - b, 3)
    gap = F.col("semantic_overall_score") - F.col("fixed_overall_score")
    return pairs.select(
        "document_id", F.col("semantic_overall_score").alias("semantic_score"), F.col("fixed_overall_score").alias("fixed_score"),
        delta(F.col("semantic_mrr"), F.col("fixed_mrr")).alias("retrieval_delta"),
        delta(F.col("semantic_avg_concept_unity") / 5, F.col("fixed_avg_concept_unity") / 5).alias("intrinsic_delta"),
        delta(F.col("semantic_preservation_score"), F.col("fixed_preservation_score")).alias("preservation_delta"),
        delta(F.col("semantic_overall_score"), F.col("fixed_overall_score")).alias("overall_delta"),
        F.when(F.abs(gap) < TIE, "tie").when(gap > 0, "semantic").otherwise("fixed").alias("winner"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "Excellent").when(score >= 0.6, "Good").otherwise("Needs Work")


#: Rules on the figures of a run: rule, measure, least value, value it stays below (None: open), level.
RUN_RULES = (
    ("first_hit_strong", "first_hit", 0.8, None, "good"), ("first_hit_fair", "first_hit", 0.6, 0.8, "fair"),
    ("first_hit_weak", "first_hit", None, 0.6, "poor"), ("tune_chunk_size", "first_hit", None, 0.7, "act"),
    ("review_order", "mrr", None, 0.6, "act"), ("focused_chunks", "unity", 0.8, None, "good"),
    ("mixed_chunks", "unity", None, 0.6, "poor"), ("split_topics", "unity", None, 0.7, "act"),
    ("broken_boundaries", "clean", None, 0.7, "poor"), ("facts_cut", "preservation", None, 0.9, "poor"),
    ("overall_strong", "overall", 0.8, None, "good"), ("overall_weak", "overall", None, 0.6, "poor"),
)
#: Rules on a comparison, by the size of a difference: rule, measure, value it must exceed, level.
COMPARISON_RULES = (
    ("retrieval_differs", "retrieval_delta", 0.05, "note"), ("form_differs", "intrinsic_delta", 0.05, "note"),
    ("retrieval_decides", "retrieval_delta", 0.1, "act"),
)


def run_insights(runs: DataFrame) -> DataFrame:
    """Which rules of RUN_RULES a run meets: (document_id, chunker_type, rule, level, value, low, high)."""
    measures = {"first_hit": F.col("hit_rate_1"), "mrr": F.col("mrr"), "unity": F.col("avg_concept_unity") / 5, "clean": F.col("clean_boundary_rate"),
                "preservation": F.col("preservation_score"), "overall": F.col("overall_score")}
    bound = lambda x: F.lit(x).cast("double")
    met = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), measures[m].alias("value"), bound(low).alias("low"), bound(high).alias("high"))
                    for rule, m, low, high, level in RUN_RULES])
    return (runs.select("document_id", "chunker_type", F.explode(met).alias("r")).select("document_id", "chunker_type", "r.*")
            .filter((F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") < F.col("high")))))


def comparison_insights(comparisons: DataFrame) -> DataFrame:
    """The verdict of a comparison and what it rests on: (document_id, rule, level, favours, value, threshold)."""
    favours = lambda delta: F.when(delta > 0, "semantic").otherwise("fixed")
    row = lambda rule, level, side, value, threshold: F.struct(
        F.lit(rule).alias("rule"), F.lit(level).alias("level"), side.alias("favours"), value.alias("value"), F.lit(threshold).alias("threshold"))
    differing = [F.when(F.abs(F.col(m)) > least, row(rule, level, favours(F.col(m)), F.col(m), least)) for rule, m, least, level in COMPARISON_RULES]
    met = F.array(row("winner", "verdict", F.col("winner"), F.col("overall_delta"), TIE), *differing)
    return (comparisons.select("document_id", F.explode(met).alias("r")).filter("r is not null").select("document_id", "r.*"))


def run_summaries(runs: DataFrame) -> DataFrame:
    """Compact JSON summary per run."""
    summary = F.struct(
        "document_id", "chunker_type",
        F.struct(F.struct("hit_rate_1", "hit_rate_3", "hit_rate_5", "mrr").alias("retrieval"),
                 F.struct("avg_concept_unity", "clean_boundary_rate", "avg_standalone_score").alias("intrinsic"),
                 F.col("preservation_score").alias("preservation"), F.col("overall_score").alias("overall")).alias("metrics"),
        F.struct("questions", "chunks", F.col("total_facts").alias("facts")).alias("counts"))
    return runs.select("document_id", "chunker_type", F.to_json(summary).alias("summary"))


# --- ground truth ---------------------------------------------------------------------------------------------

def expected_entities(graph: AuditGraph, limit: int | None = None) -> DataFrame:
    """(question_id, id): the entities each evaluation question is about.

    Every label is read once: a node carries the numbers of the questions whose filters it meets, and those that also
    ask for a relationship remain if an edge says so. With a ``limit`` each question is a search of its own.
    """
    asked: dict[str, list[tuple]] = {}
    for question_id, _, label, filters, relationship, _ in GROUND_TRUTH:
        nodes = graph.extractions if label == "Extraction" else graph.node(label)
        if not set(filters) - set(nodes.columns):  # a property no node has matches nothing
            edge = relationship and {"type": relationship[0], "direction": relationship[1], "target_label": relationship[2]}
            asked.setdefault(label, []).append((question_id, filters, edge))
    found = []
    for label, questions in asked.items():
        nodes = graph.extractions if label == "Extraction" else graph.node(label)
        if limit is None:
            found.append(_asked_about(graph, label, nodes, questions))
            continue
        for question_id, filters, edge in questions:
            ids = nodes.filter(matches(filters)).select("id").orderBy("id").limit(limit) if label == "Extraction" else related_ids(graph, label, filters, edge, limit)
            found.append(ids.select(F.lit(question_id).alias("question_id"), "id"))
    return reduce(DataFrame.unionByName, found)


def _asked_about(graph: AuditGraph, label: str, nodes: DataFrame, questions: Sequence[tuple]) -> DataFrame:
    """(question_id, id) for the questions (id, filters, relationship or None) on the table of nodes of a label."""
    met = lambda some: F.array_compact(F.array(*[F.when(matches(filters), F.lit(q)) for q, filters, _ in some])) if some else F.array().cast("array<int>")
    free, tied = [q for q in questions if not q[2]], [q for q in questions if q[2]]
    marked = nodes.select("id", met(free).alias("free"), met(tied).alias("tied"))
    if not tied:
        return marked.select(F.explode("free").alias("question_id"), "id")
    ends = reduce(DataFrame.unionByName, [edge_ends(graph, edge, label).select("id", F.lit(q).alias("question_id")) for q, _, edge in tied])
    linked = ends.groupBy("id").agg(F.collect_set("question_id").alias("linked"))  # at most one entry a question
    both = F.concat("free", F.array_intersect("tied", F.coalesce("linked", F.array().cast("array<int>"))))
    return marked.join(linked, "id", "left").select(F.explode(both).alias("question_id"), "id")


def entity_scores(questions: DataFrame, expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Precision, recall, F1 per question, and count accuracy of aggregation questions."""
    sides = (expected.select("question_id", "id", F.lit(1).alias("side"))
             .unionByName(retrieved.select("question_id", "id", F.lit(2).alias("side")))
             .groupBy("question_id", "id").agg(F.bit_or("side").alias("side"))
             .groupBy("question_id").agg(
                 F.sum((F.col("side") != 2).cast("int")).alias("n_expected"), F.sum((F.col("side") != 1).cast("int")).alias("n_retrieved"),
                 F.sum((F.col("side") == 3).cast("int")).alias("n_shared")))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    counts = questions.join(sides, "question_id", "left").select(
        "question_id", "category", n("n_expected").alias("n_expected"), n("n_retrieved").alias("n_retrieved"), n("n_shared").alias("n_shared"))
    precision, recall = ratio(F.col("n_shared"), F.col("n_retrieved")), ratio(F.col("n_shared"), F.col("n_expected"))
    accuracy = F.when(F.col("n_expected") == 0, F.when(F.col("n_retrieved") == 0, 1.0).otherwise(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - F.abs(F.col("n_expected") - F.col("n_retrieved")) / F.col("n_expected")))
    scored = counts.withColumns({"precision": precision, "recall": recall})
    return scored.withColumns({
        "f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "count_accuracy": F.when(F.col("category") == "aggregation", accuracy)})


def keyword_coverage(keywords: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Share of a question's required keywords that occur in its retrieved texts."""
    texts = retrieved.select("question_id", F.lower("text").alias("text"))
    per_keyword = keywords.join(texts, "question_id", "left").groupBy("question_id", "keyword").agg(
        F.max(F.coalesce(F.contains("text", F.lower("keyword")), F.lit(False)).cast("int")).alias("found"))
    return per_keyword.groupBy("question_id").agg((F.sum("found") / F.count(F.lit(1))).alias("coverage"))


def category_means(scores: DataFrame) -> DataFrame:
    """Mean precision, recall, F1 and coverage per category and overall."""
    measures = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("precision", "recall", "f1", "coverage")]
    return scores.rollup("category").agg(F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("questions"), *measures).select(
        F.when(F.col("_all") == 1, OVERALL).otherwise(F.col("category")).alias("category"), "questions",
        *[f"avg_{c}" for c in ("precision", "recall", "f1", "coverage")])


def distribution_check(rows: DataFrame, key: str, expected: Mapping[str, int]) -> DataFrame:
    """Actual against expected count per key; ``matches`` is null where no count (0) is expected."""
    known = rows.sparkSession.createDataFrame(list(expected.items()), "key string, expected bigint")
    actual = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("actual"))
    return actual.join(known, "key", "full_outer").select(
        "key", F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"), F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"),
        F.when(F.col("expected") > 0, F.col("expected") == F.coalesce("actual", F.lit(0))).alias("matches"))
