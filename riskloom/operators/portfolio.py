"""Portfolio analytics: exposure, effectiveness, trends, compliance, process health.

Figures count distinct entities. Columns named ``row_*`` count joined rows instead, the way a
pattern match with optional parts does, where an entity reached along several paths counts once
per path. Each path is aggregated on its own key before it meets another, so sibling paths never
multiply and a much-linked entity stays one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.dates import day_component, elapsed_days, iso_day
from riskloom.functions.rounding import percentage, ratio, round_half_up
from riskloom.graph import AuditGraph

TOTAL = "TOTAL"


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _sum(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def fan_in(graph: AuditGraph, rel_type: str, key: str, alias: str, **labels: str) -> DataFrame:
    """Edge count per end: one row per ``key`` ('src' or 'dst') of the given edges."""
    return (graph.edge(rel_type, **labels).groupBy(F.col(key).alias("id"))
            .agg(F.count(F.lit(1)).alias(alias)))


def with_known_keys(facts: DataFrame, key: str, known: tuple[str, ...]) -> DataFrame:
    """Adds one all-null row per enum value so grouping by ``key`` reports absent values as zero."""
    blanks = facts.sparkSession.createDataFrame([(value,) for value in known], f"{key} string")
    return facts.withColumn("_fact", F.lit(1)).unionByName(blanks, allowMissingColumns=True)


def by_key_and_total(facts: DataFrame, key: str, known: tuple[str, ...], *measures: Column) -> DataFrame:
    """Grouped measures, zero-filled over ``known``, plus a TOTAL row. ``_fact`` marks real rows."""
    return (with_known_keys(facts, key, known).rollup(key).agg(F.grouping(key).alias("_all"), *measures)
            .withColumn(key, F.when(F.col("_all") == 1, TOTAL).otherwise(F.col(key))).drop("_all"))


# --- risks ------------------------------------------------------------------

def risk_paths(graph: AuditGraph) -> DataFrame:
    """Per risk: implied or explicit, mitigated through a failure mode, and joined-row counts."""
    controls = fan_in(graph, "MITIGATES", "dst", "n_controls", dst_label="FailureMode")
    paths = (
        graph.edge("IMPLIES").select(F.col("src").alias("id"), F.col("dst").alias("risk_id"))
        .join(controls, "id", "left")
        .groupBy("risk_id").agg(
            F.sum(F.coalesce("n_controls", F.lit(1))).alias("n_rows"),
            F.sum(F.when(F.col("n_controls").isNull(), 1).otherwise(0)).alias("n_open_rows"),
            F.max(F.col("n_controls").isNotNull()).alias("mitigated"),
        )
    )
    return (
        graph.node("Risk").select(F.col("id").alias("risk_id"), "level", "created_at")
        .join(paths, "risk_id", "left")
        .select(
            "risk_id", "level", "created_at",
            F.col("n_rows").isNotNull().alias("implied"),
            F.coalesce("mitigated", F.lit(False)).alias("mitigated"),
            F.coalesce("n_rows", F.lit(1)).alias("n_rows"),
            F.coalesce("n_open_rows", F.lit(1)).alias("n_open_rows"),
        )
    )


def risk_exposure(graph: AuditGraph) -> DataFrame:
    """Counts per risk level and in total: all, unmitigated, implied, explicit."""
    real, implied, open_ = F.col("_fact") == 1, F.col("implied"), ~F.col("mitigated")
    return by_key_and_total(
        risk_paths(graph), "level", schemas.RISK_LEVELS,
        _count_if(real).alias("risks"),
        _count_if(real & open_).alias("unmitigated"),
        _count_if(real & implied).alias("implied"),
        _count_if(real & ~implied).alias("explicit"),
        _sum("n_rows").alias("row_risks"),
        _sum("n_open_rows").alias("row_unmitigated"),
        _sum(F.when(implied, F.col("n_rows"))).alias("row_implied"),
        _sum(F.when(~implied, F.col("n_rows"))).alias("row_explicit"),
    )


def unmitigated_critical_risks(graph: AuditGraph) -> DataFrame:
    return (risk_paths(graph).filter("level = 'CRITICAL' and not mitigated")
            .select("risk_id", "level", F.col("n_open_rows").cast("bigint").alias("row_count")))


def risk_trends(graph: AuditGraph, rows: int | None = None) -> DataFrame:
    """Risks created per day and level, newest first; all, or the first ``rows``."""
    out = (
        graph.node("Risk").groupBy(iso_day(F.col("created_at")).alias("date"), F.col("level").alias("label"))
        .agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.desc("date"), "label")
    )
    return out if rows is None else out.limit(rows)


# --- controls ---------------------------------------------------------------

def control_reach(graph: AuditGraph) -> DataFrame:
    """Distinct (control, risk) pairs linked through a failure mode."""
    mitigates = graph.edge("MITIGATES", dst_label="FailureMode").select(
        F.col("src").alias("control_id"), F.col("dst").alias("fm_id")).distinct()
    implies = graph.edge("IMPLIES").select(F.col("src").alias("fm_id"), F.col("dst").alias("risk_id")).distinct()
    return mitigates.join(implies, "fm_id").select("control_id", "risk_id").distinct()


def control_facts(graph: AuditGraph) -> DataFrame:
    """Per control: distinct risks covered and whether a procedure step implements it."""
    risks = control_reach(graph).groupBy("control_id").agg(F.count(F.lit(1)).alias("risk_count"))
    steps = fan_in(graph, "IMPLEMENTS", "dst", "n_steps").withColumnRenamed("id", "control_id")
    return (
        graph.node("Control").select(F.col("id").alias("control_id"), "control_type", "effectiveness")
        .join(risks, "control_id", "left").join(steps, "control_id", "left")
        .select("control_id", "control_type", "effectiveness",
                F.coalesce("risk_count", F.lit(0)).cast("bigint").alias("risk_count"),
                F.col("n_steps").isNotNull().alias("has_steps"))
    )


def control_effectiveness(graph: AuditGraph, high: float = 80.0, low: float = 50.0) -> DataFrame:
    """Counts, mean effectiveness and operationalisation per control type and in total."""
    real, eff = F.col("_fact") == 1, F.col("effectiveness")
    return by_key_and_total(
        control_facts(graph), "control_type", schemas.CONTROL_TYPES,
        _count_if(real).alias("controls"),
        F.coalesce(F.round(F.avg(eff), 6), F.lit(0.0)).alias("avg_effectiveness"),
        _count_if(eff > high).alias("high_effectiveness"),
        _count_if(eff < low).alias("low_effectiveness"),
        _count_if(real & F.col("has_steps")).alias("with_steps"),
        _count_if(real & ~F.col("has_steps")).alias("without_steps"),
        _sum("risk_count").alias("row_risks_covered"),
    )


def control_coverage(graph: AuditGraph) -> DataFrame:
    """Risks covered by controls: distinct figure and the per-control sum (``row_*``)."""
    mitigated = graph.edge("MITIGATES", dst_label="FailureMode").select(F.col("dst").alias("src")).distinct()
    covered = (graph.edge("IMPLIES").join(mitigated, "src", "left_semi")
               .select(F.col("dst").alias("id")).distinct().withColumn("covered", F.lit(1)))
    risks = graph.node("Risk").select("id").join(covered, "id", "left").select(
        F.lit(1).alias("risk"), "covered", F.lit(None).cast("bigint").alias("reach"))
    reach = control_facts(graph).select(
        F.lit(None).cast("int").alias("risk"), F.lit(None).cast("int").alias("covered"),
        F.col("risk_count").alias("reach"))
    totals = risks.unionByName(reach).agg(
        _sum("risk").alias("total_risks"), _sum("covered").alias("risks_covered"),
        _sum("reach").alias("row_risks_covered"))
    return totals.select(
        "total_risks", "risks_covered",
        (F.col("total_risks") - F.col("risks_covered")).alias("risks_uncovered"),
        percentage(F.col("risks_covered"), F.col("total_risks")).alias("coverage_percentage"),
        "row_risks_covered",
        (F.col("total_risks") - F.col("row_risks_covered")).alias("row_risks_uncovered"),
        percentage(F.col("row_risks_covered"), F.col("total_risks")).alias("row_coverage_percentage"),
    )


# --- failure modes ----------------------------------------------------------

def rpn_bucket(rpn: Column) -> Column:
    return (F.when(rpn.isNull(), "unknown").when(rpn > 200, "critical").when(rpn > 100, "high")
            .when(rpn > 50, "medium").otherwise("low"))


def failure_mode_facts(graph: AuditGraph) -> DataFrame:
    """Per failure mode: RPN bucket, mitigation, joined-row count."""
    risks = fan_in(graph, "IMPLIES", "src", "n_risks")
    controls = fan_in(graph, "MITIGATES", "dst", "n_controls", dst_label="FailureMode")
    one = F.lit(1)
    return (
        graph.node("FailureMode").select("id", "code", "rpn", rpn_bucket(F.col("rpn")).alias("rpn_bucket"))
        .join(risks, "id", "left").join(controls, "id", "left")
        .select("id", "code", "rpn", "rpn_bucket", F.col("n_controls").isNotNull().alias("mitigated"),
                (F.coalesce("n_risks", one) * F.coalesce("n_controls", one)).alias("n_rows"))
    )


def failure_mode_analysis(graph: AuditGraph) -> DataFrame:
    """Totals, unmitigated and mitigation percentage per RPN bucket and overall."""
    real, mitigated = F.col("_fact") == 1, F.col("mitigated")
    out = by_key_and_total(
        failure_mode_facts(graph), "rpn_bucket", schemas.RPN_BUCKETS,
        _count_if(real).alias("failure_modes"),
        _count_if(real & ~mitigated).alias("unmitigated"),
        _sum("n_rows").alias("row_failure_modes"),
        _sum(F.when(~mitigated, F.col("n_rows"))).alias("row_unmitigated"),
    )
    share = lambda total, gap: percentage(F.col(total) - F.col(gap), F.col(total))
    return out.withColumns({
        "mitigation_coverage": share("failure_modes", "unmitigated"),
        "row_mitigation_coverage": share("row_failure_modes", "row_unmitigated"),
    })


def unmitigated_critical_failure_modes(graph: AuditGraph) -> DataFrame:
    return (failure_mode_facts(graph).filter("rpn_bucket = 'critical' and not mitigated")
            .select("id", "code", F.col("rpn").cast("bigint").alias("rpn")))


# --- findings ---------------------------------------------------------------

def finding_trends(graph: AuditGraph) -> DataFrame:
    """Findings by status and by priority, zero-filled, as (dimension, key, findings) rows."""
    counts = (
        graph.node("Finding").groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))
        .select("n", F.explode(F.array(
            F.struct(F.lit("status").alias("dimension"), F.col("status").alias("key")),
            F.struct(F.lit("priority").alias("dimension"), F.col("priority").alias("key")),
        )).alias("d")).select("d.dimension", "d.key", "n")
    )
    known = [("status", s, 0) for s in schemas.FINDING_STATUSES] + [
        ("priority", p, 0) for p in schemas.FINDING_PRIORITIES]
    blanks = graph.spark.createDataFrame(known, "dimension string, key string, n bigint")
    return counts.unionByName(blanks).groupBy("dimension", "key").agg(F.sum("n").alias("findings"))


def finding_resolution(graph: AuditGraph, as_of: str) -> DataFrame:
    """Resolution rates over the last 30 / 90 days before ``as_of`` and over all time."""
    resolved = F.col("status").isin("RESOLVED", "CLOSED")
    days = elapsed_days(F.col("created_at"), F.col("updated_at"))
    since = lambda n: F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(n))
    totals = graph.node("Finding").agg(
        F.count(F.lit(1)).alias("total"), _count_if(resolved).alias("resolved"),
        _count_if(resolved & (F.col("updated_at") >= since(30))).alias("recent_30"),
        _count_if(resolved & (F.col("updated_at") >= since(90))).alias("recent_90"),
        F.avg(F.when(resolved & (days > 0), days)).alias("days"),
    )
    rate = lambda part, whole: F.round(ratio(F.col(part), F.col(whole), 100.0), 6)
    return totals.select(
        "total", "resolved",
        rate("recent_30", "resolved").alias("last_30_days"), rate("recent_90", "resolved").alias("last_90_days"),
        rate("resolved", "total").alias("all_time"),
        F.coalesce(F.round("days", 6), F.lit(0.0)).alias("average_resolution_days"),
    )


def finding_resolution_trends(graph: AuditGraph, rows: int | None = None) -> DataFrame:
    """Resolved findings per (created day, resolved day, day component), latest first; all, or the first ``rows``."""
    created, updated = F.col("created_at"), F.col("updated_at")
    out = (
        graph.node("Finding").filter(F.col("status").isin("RESOLVED", "CLOSED"))
        .groupBy(iso_day(created).alias("created_date"), iso_day(updated).alias("date"),
                 day_component(created, updated).cast("bigint").alias("resolution_days"))
        .agg(F.count(F.lit(1)).alias("value")).withColumn("label", F.lit("Resolved"))
        .orderBy(F.desc("date"), F.desc("created_date"), "resolution_days")
    )
    return out if rows is None else out.limit(rows)


# --- compliance -------------------------------------------------------------

def requirement_links(graph: AuditGraph) -> DataFrame:
    """Requirement ⟕ satisfaction edge ⟕ document: one row per edge, or one 'unknown' row."""
    documents = graph.node("Document").select(F.col("id").alias("src"), "document_type")
    links = graph.edges("SATISFIES", "FAILS_TO_SATISFY").join(documents, "src").select(
        F.col("dst").alias("requirement_id"), "rel_type", "document_type")
    state = (F.when(F.col("rel_type") == "SATISFIES", "satisfied")
             .when(F.col("rel_type") == "FAILS_TO_SATISFY", "failed").otherwise("unknown"))
    return (graph.node("Requirement").select(F.col("id").alias("requirement_id"), "requirement_type")
            .join(links, "requirement_id", "left")
            .select("requirement_id", "requirement_type", state.alias("state"), "document_type"))


def compliance_status(graph: AuditGraph) -> DataFrame:
    """(dimension, key) rows: requirements per type / state / document type, distinct and joined."""
    per_requirement = requirement_links(graph).groupBy("requirement_id", "requirement_type", "state", "document_type").agg(
        F.count(F.lit(1)).alias("n_rows"))
    facts = per_requirement.select("requirement_id", "n_rows", F.explode(F.array(
        F.struct(F.lit("requirement_type").alias("dimension"), F.col("requirement_type").alias("key")),
        F.struct(F.lit("state").alias("dimension"), F.col("state").alias("key")),
        F.struct(F.lit("document_type").alias("dimension"), F.col("document_type").alias("key")),
        F.struct(F.lit("all").alias("dimension"), F.lit(TOTAL).alias("key")),
    )).alias("d")).select("requirement_id", "n_rows", "d.dimension", "d.key").filter("key is not null")
    known = ([("requirement_type", k) for k in schemas.REQUIREMENT_TYPES]
             + [("state", k) for k in schemas.SATISFACTION_STATES]
             + [("document_type", k) for k in schemas.DOCUMENT_TYPES])
    blanks = graph.spark.createDataFrame(known, "dimension string, key string")
    return (
        facts.groupBy("dimension", "key", "requirement_id").agg(F.sum("n_rows").alias("n_rows"))
        .unionByName(blanks, allowMissingColumns=True)
        .groupBy("dimension", "key").agg(F.count("requirement_id").alias("requirements"),
                                         _sum("n_rows").alias("row_requirements"))
    )


def compliance_gaps(graph: AuditGraph) -> DataFrame:
    """Requirements that failed at least once or have no satisfaction edge at all."""
    return (requirement_links(graph).filter("state <> 'satisfied'")
            .groupBy("requirement_id", "requirement_type", "state")
            .agg(F.count(F.lit(1)).alias("row_count")))


# --- processes --------------------------------------------------------------

def process_health(graph: AuditGraph) -> DataFrame:
    """Per process: has procedures, distinct critical risks along audit, document, failure mode."""
    hop = lambda rel, a, b: graph.edge(rel).select(F.col("src").alias(a), F.col("dst").alias(b))
    critical = graph.node("Risk").filter("level = 'CRITICAL'").select(F.col("id").alias("risk_id"))
    chain = hop("IMPLIES", "fm_id", "risk_id").join(critical, "risk_id", "left_semi")
    for rel, near, far in (("IDENTIFIES", "document_id", "fm_id"), ("USES", "audit_id", "document_id")):
        chain = hop(rel, near, far).join(chain, far).select(near, "risk_id").distinct()
    critical_counts = (
        graph.edge("EVALUATES").select(F.col("src").alias("audit_id"), F.col("dst").alias("process_id"))
        .join(chain, "audit_id").select("process_id", "risk_id").distinct()
        .groupBy("process_id").agg(F.count(F.lit(1)).alias("critical_risks"))
    )
    steps = graph.node("ProcedureStep").groupBy("process_id").agg(F.count(F.lit(1)).alias("steps"))
    return (
        graph.node("Process").select(F.col("id").alias("process_id"), "name", "version")
        .join(steps, "process_id", "left").join(critical_counts, "process_id", "left")
        .select("process_id", "name", "version",
                F.concat_ws(":", "name", "version").alias("version_key"),
                F.coalesce("steps", F.lit(0)).cast("bigint").alias("procedure_steps"),
                F.col("steps").isNotNull().alias("has_procedures"),
                F.coalesce("critical_risks", F.lit(0)).cast("bigint").alias("critical_risks"))
    )


def process_summary(graph: AuditGraph) -> DataFrame:
    return process_health(graph).agg(
        F.count(F.lit(1)).alias("processes"),
        _count_if(F.col("has_procedures")).alias("with_procedures"),
        _count_if(~F.col("has_procedures")).alias("without_procedures"),
        _count_if(F.col("critical_risks") > 0).alias("high_risk_processes"),
    )


def process_versions(graph: AuditGraph) -> DataFrame:
    return (graph.node("Process").groupBy(F.concat_ws(":", "name", "version").alias("version_key"))
            .agg(F.count(F.lit(1)).alias("processes")))


# --- everything -------------------------------------------------------------

def _long(df: DataFrame, section: str, keys: list[str]) -> DataFrame:
    metrics = [c for c in df.columns if c not in keys]
    values = df.select(F.concat_ws("/", *keys).alias("key"),
                       *[F.col(m).cast("double").alias(m) for m in metrics])
    return values.unpivot("key", metrics, "metric", "value").select(
        F.lit(section).alias("section"), "metric", "key", "value")


def portfolio(graph: AuditGraph, as_of: str) -> DataFrame:
    """All portfolio figures as (section, metric, key, value) rows in one plan."""
    sections = [
        _long(risk_exposure(graph), "risk_exposure", ["level"]),
        _long(control_effectiveness(graph), "control_effectiveness", ["control_type"]),
        _long(control_coverage(graph), "control_coverage", []),
        _long(failure_mode_analysis(graph), "failure_mode_analysis", ["rpn_bucket"]),
        _long(finding_trends(graph), "finding_trends", ["dimension", "key"]),
        _long(finding_resolution(graph, as_of), "finding_resolution", []),
        _long(compliance_status(graph), "compliance_status", ["dimension", "key"]),
        _long(process_summary(graph), "process_health", []),
    ]
    return reduce(DataFrame.unionByName, sections).withColumn("value", round_half_up(F.col("value"), 4))
