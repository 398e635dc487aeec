"""Connectivity diagnostics and audit summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.bitsets import bitsets, members, unite
from riskloom.graph import AuditGraph

STAT_LABELS = ("Process", "FailureMode", "Risk", "Control", "Finding", "Requirement", "Audit", "Document")


def _ends(graph: AuditGraph, rel: str, key: str, alias: str, **labels: str) -> DataFrame:
    """Distinct node ids at one end of an edge type, flagged with ``alias``."""
    return (graph.edge(rel, **labels).select(F.col(key).alias("id")).distinct()
            .withColumn(alias, F.lit(True)))


def _flagged(nodes: DataFrame, *flags: DataFrame) -> DataFrame:
    for flag in flags:
        nodes = nodes.join(flag, "id", "left")
    return nodes


def _has(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def _count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count(F.when(condition, 1))


def control_connectivity(graph: AuditGraph) -> DataFrame:
    nodes = _flagged(graph.node("Control").select("id"),
                     _ends(graph, "MITIGATES", "src", "risks", dst_label="Risk"),
                     _ends(graph, "MITIGATES", "src", "modes", dst_label="FailureMode"))
    return nodes.agg(
        _count().alias("total_controls"), _count(_has("risks")).alias("controls_linked_to_risks"),
        _count(_has("modes")).alias("controls_linked_to_failure_modes"),
        _count(~_has("risks") & ~_has("modes")).alias("orphaned_controls"))


def risk_connectivity(graph: AuditGraph) -> DataFrame:
    mitigated = _ends(graph, "MITIGATES", "dst", "indirect", dst_label="FailureMode")
    modes = (graph.edge("IMPLIES").select(F.col("src").alias("id"), "dst").join(mitigated, "id", "left")
             .groupBy(F.col("dst").alias("id"))
             .agg(F.lit(True).alias("modes"), F.max(_has("indirect")).alias("indirect")))
    nodes = _flagged(graph.node("Risk").select("id"),
                     _ends(graph, "MITIGATES", "dst", "direct", dst_label="Risk"), modes)
    return nodes.agg(
        _count().alias("total_risks"), _count(_has("direct")).alias("risks_with_direct_controls"),
        _count(_has("indirect")).alias("risks_with_indirect_controls"),
        _count(~_has("direct") & ~_has("indirect")).alias("unmitigated_risks"),
        _count(~_has("modes")).alias("standalone_risks"))


def failure_mode_connectivity(graph: AuditGraph) -> DataFrame:
    nodes = _flagged(graph.node("FailureMode").select("id"),
                     _ends(graph, "MITIGATES", "dst", "controls", dst_label="FailureMode"),
                     _ends(graph, "IMPLIES", "src", "risks"))
    return nodes.agg(
        _count().alias("total_failure_modes"), _count(_has("controls")).alias("mitigated_failure_modes"),
        _count(~_has("controls")).alias("unmitigated_failure_modes"),
        _count(_has("risks")).alias("failure_modes_with_risks"),
        _count(~_has("risks")).alias("orphaned_failure_modes"))


def requirement_connectivity(graph: AuditGraph) -> DataFrame:
    nodes = _flagged(graph.node("Requirement").select("id"),
                     _ends(graph, "SATISFIES", "dst", "satisfied"),
                     _ends(graph, "FAILS_TO_SATISFY", "dst", "failed"))
    return nodes.agg(
        _count().alias("total_requirements"), _count(_has("satisfied")).alias("satisfied_requirements"),
        _count(_has("failed")).alias("failed_requirements"),
        _count(~_has("satisfied") & ~_has("failed")).alias("unknown_requirements"))


def process_connectivity(graph: AuditGraph, key: str = "id") -> DataFrame:
    """``key``: steps name their process by 'id' or by 'name_version' (``name:version``)."""
    step_key = {"id": F.col("id"), "name_version": F.concat_ws(":", "name", "version")}[key]
    with_steps = graph.node("ProcedureStep").select(F.col("process_id").alias("step_key")).distinct().withColumn("steps", F.lit(True))
    with_documents = (
        graph.edge("EVALUATES").select(F.col("src").alias("audit"), F.col("dst").alias("id"))
        .join(graph.edge("USES").select(F.col("src").alias("audit")).distinct(), "audit", "left_semi")
        .select("id").distinct().withColumn("documents", F.lit(True)))
    nodes = (graph.node("Process").select("id", step_key.alias("step_key"))
             .join(with_steps, "step_key", "left").join(with_documents, "id", "left"))
    return nodes.agg(
        _count().alias("total_processes"), _count(_has("steps")).alias("processes_with_steps"),
        _count(~_has("steps")).alias("processes_without_steps"),
        _count(_has("documents")).alias("processes_with_documents"),
        _count(~_has("documents")).alias("processes_without_documents"))


def relationship_counts(graph: AuditGraph) -> DataFrame:
    return (graph.edges().groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"))
            .orderBy(F.desc("edges"), "rel_type"))


# --- audits -------------------------------------------------------------------

def _audit_modes(graph: AuditGraph) -> tuple[DataFrame, DataFrame]:
    """Distinct (audit, document) and (audit, failure mode) pairs."""
    uses = graph.edge("USES").select(F.col("src").alias("audit_id"), F.col("dst").alias("document_id")).distinct()
    identifies = graph.edge("IDENTIFIES").select(F.col("src").alias("document_id"), F.col("dst").alias("fm_id"))
    return uses, uses.join(identifies, "document_id").select("audit_id", "fm_id").distinct()


def _per_audit(pairs: DataFrame, alias: str) -> DataFrame:
    return pairs.groupBy("audit_id").agg(F.count(F.lit(1)).alias(alias))


def _reached_per_audit(modes: DataFrame, **ends: DataFrame) -> DataFrame:
    """Distinct ends that an audit reaches over its failure modes, one column for each of the given (fm_id, id) links.

    Ends travel as sets of bits per failure mode, all kinds in one join, so audits times ends is never written.
    """
    links = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "fm_id", F.col("end_id")) for kind, df in ends.items()])
    sets = bitsets(links, "fm_id", "end_id", ["kind"])
    reached = unite(modes.join(sets, "fm_id"), ["audit_id", "kind"], {"bits": None})
    return reached.groupBy("audit_id").agg(*[F.sum(F.when(F.col("kind") == kind, members("bits"))).alias(kind) for kind in ends])


def _mitigating(graph: AuditGraph) -> DataFrame:
    return graph.edge("MITIGATES", dst_label="FailureMode").select(F.col("dst").alias("fm_id"), F.col("src").alias("end_id"))


def audit_summary(graph: AuditGraph, all_findings: bool = False) -> DataFrame:
    """Per audit: its process, documents, failure modes, high risks, controls and findings.

    High risks are HIGH or CRITICAL and findings address one of the audit's failure modes.
    ``all_findings`` is the served variant: HIGH only, every finding in the graph counted.
    """
    uses, modes = _audit_modes(graph)
    levels = ("HIGH",) if all_findings else ("HIGH", "CRITICAL")
    high = graph.node("Risk").filter(F.col("level").isin(*levels)).select(F.col("id").alias("end_id"))
    implies = graph.edge("IMPLIES").select(F.col("src").alias("fm_id"), F.col("dst").alias("end_id")).join(high, "end_id", "left_semi")
    ends = {"high_risks": implies, "controls": _mitigating(graph)}
    if not all_findings:
        ends["findings"] = graph.edge("ADDRESSES").select(F.col("dst").alias("fm_id"), F.col("src").alias("end_id"))
    counts = [_per_audit(uses, "documents"), _per_audit(modes, "failure_modes"), _reached_per_audit(modes, **ends)]
    processes = graph.node("Process").select(
        F.col("id").alias("process_id"), F.col("name").alias("process_name"), F.col("version").alias("process_version"))
    evaluates = (graph.edge("EVALUATES").select(F.col("src").alias("audit_id"), F.col("dst").alias("process_id"))
                 .join(processes, "process_id"))
    out = graph.node("Audit").select(F.col("id").alias("audit_id")).join(evaluates, "audit_id", "left")
    for branch in counts:
        out = out.join(branch, "audit_id", "left")
    if all_findings:
        findings = graph.node("Finding").agg(F.count(F.lit(1)))
        out = out.withColumn("findings", findings.scalar())
    out = out.fillna(0, ["documents", "failure_modes", "high_risks", "controls", "findings"])
    return out.select("audit_id", "process_id", "process_name", "process_version",
                      "documents", "failure_modes", "high_risks", "controls", "findings")


def audit_documents(graph: AuditGraph) -> DataFrame:
    """The documents of each audit, one row each."""
    documents = graph.node("Document").select(F.col("id").alias("dst"), "document_type", "uploaded_at")
    return graph.edge("USES").join(documents, "dst").select(
        F.col("src").alias("audit_id"), F.col("dst").alias("document_id"), "document_type", "uploaded_at")


def audit_relationship_stats(graph: AuditGraph) -> DataFrame:
    """'failure modes->risks' and 'controls->failure modes' per audit with documents.

    The failure mode only counts when it implies a risk; its controls count with it.
    """
    _, modes = _audit_modes(graph)
    implies = graph.edge("IMPLIES").select(F.col("src").alias("fm_id"), F.col("dst").alias("end_id"))
    risky = modes.join(implies, "fm_id", "left_semi")
    out = graph.edge("USES").select(F.col("src").alias("audit_id")).distinct()
    for branch in (_per_audit(risky, "n_modes"), _reached_per_audit(risky, n_risks=implies, n_controls=_mitigating(graph))):
        out = out.join(branch, "audit_id", "left")
    out = out.fillna(0, ["n_modes", "n_risks", "n_controls"])
    return out.select("audit_id", F.concat_ws("->", "n_modes", "n_risks").alias("fm_to_risk"),
                      F.concat_ws("->", "n_controls", "n_modes").alias("control_to_fm"))


def ontology_stats(graph: AuditGraph) -> DataFrame:
    """Entities per label, their total, failure modes above RPN 100, open findings."""
    flags = {"FailureMode": F.col("rpn") > 100, "Finding": F.col("status") == "OPEN"}
    parts = []
    for label in STAT_LABELS:
        parts.append(graph.node(label).agg(
            F.lit(label).alias("metric"), F.count(F.lit(1)).alias("n"),
            F.count(F.when(flags.get(label, F.lit(False)), 1)).alias("flagged")))
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    rows = counts.select(F.explode(F.array(
        F.struct(F.col("metric").alias("metric"), F.col("n").alias("value")),
        F.struct(F.lit("total_entities").alias("metric"), F.col("n").alias("value")),
        F.struct(F.when(F.col("metric") == "FailureMode", "high_risk_failure_modes")
                 .when(F.col("metric") == "Finding", "open_findings").alias("metric"), F.col("flagged").alias("value")),
    )).alias("m")).select("m.metric", "m.value").filter("metric is not null")
    return rows.groupBy("metric").agg(F.sum("value").alias("value"))


assert set(STAT_LABELS) <= set(schemas.LABELS)
