"""Coverage gaps: entities that lack the control or procedure step they should have.

Each named query gives every gap; :func:`coverage` runs it by name in report order, all of it or the
first ``limit`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.graph import AuditGraph

_QUERIES: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], str, tuple[str, ...]]] = {}


def register_coverage_query(name: str, order: tuple[str, ...], description: str,
                            params: tuple[str, ...] = ()) -> Callable:
    """Adds a query to the catalogue under ``name``; ``order`` is a list of SQL sort keys."""
    def add(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _QUERIES[name] = (query, order, description, params)
        return query
    return add


def coverage(name: str, graph: AuditGraph, limit: int | None = None, **params: object) -> DataFrame:
    """Runs a named coverage query in report order."""
    if name not in _QUERIES:
        raise ValueError(f"Unknown coverage query: {name}")
    query, order, _, required = _QUERIES[name]
    for param in required:
        if not params.get(param):
            raise ValueError(f"{param} parameter is required for {name} query")
    rows = query(graph, **params).orderBy(*[F.desc(k[:-5]) if k.endswith(" desc") else F.asc(k) for k in order])
    return rows if limit is None else rows.limit(limit)


def available_coverage_queries() -> list[dict[str, object]]:
    return [{"name": name, "description": text, "params": list(params)}
            for name, (_, _, text, params) in _QUERIES.items()]


def _targets(graph: AuditGraph, rel: str, dst_label: str | None = None) -> DataFrame:
    return graph.edge(rel, dst_label=dst_label).select(F.col("dst").alias("id")).distinct()


def _implemented(graph: AuditGraph) -> DataFrame:
    return graph.edge("IMPLEMENTS", src_label="ProcedureStep").select(F.col("dst").alias("control_id")).distinct()


def _mitigations(graph: AuditGraph, dst_label: str, target: str) -> DataFrame:
    return graph.edge("MITIGATES", dst_label=dst_label).select(
        F.col("src").alias("control_id"), F.col("dst").alias(target))


_NEWEST = ("created_at desc", "id")


@register_coverage_query("risks-without-controls", _NEWEST, "Risks no control mitigates directly")
def risks_without_controls(graph: AuditGraph) -> DataFrame:
    return graph.node("Risk").join(_targets(graph, "MITIGATES", "Risk"), "id", "left_anti").select(
        "id", "level", "created_at")


@register_coverage_query("controls-without-steps", _NEWEST, "Controls no procedure step implements")
def controls_without_steps(graph: AuditGraph) -> DataFrame:
    done = _implemented(graph).withColumnRenamed("control_id", "id")
    return graph.node("Control").join(done, "id", "left_anti").select("id", "control_type", "created_at")


@register_coverage_query("unmitigated-high-rpn", ("rpn desc", "id"),
                         "Failure modes above an RPN threshold that no control mitigates")
def unmitigated_high_rpn(graph: AuditGraph, threshold: int = 100) -> DataFrame:
    return (graph.node("FailureMode").filter(F.col("rpn") > threshold)
            .join(_targets(graph, "MITIGATES", "FailureMode"), "id", "left_anti")
            .select("id", "code", F.col("rpn").cast("bigint").alias("rpn")))


@register_coverage_query("risks-without-procedure-controls", _NEWEST,
                         "Risks without an implemented control, direct or through a failure mode")
def risks_without_procedure_controls(graph: AuditGraph) -> DataFrame:
    implemented = _implemented(graph)
    direct = _mitigations(graph, "Risk", "id").join(implemented, "control_id", "left_semi").select("id")
    modes = _mitigations(graph, "FailureMode", "src").join(implemented, "control_id", "left_semi").select("src").distinct()
    through_mode = graph.edge("IMPLIES").join(modes, "src", "left_semi").select(F.col("dst").alias("id"))
    covered = direct.unionByName(through_mode).distinct()
    return graph.node("Risk").join(covered, "id", "left_anti").select("id", "level", "created_at")


def ipar_control_gaps(graph: AuditGraph) -> DataFrame:
    """(document, control) gaps of all IPAR documents: mitigating controls no step implements."""
    open_controls = _mitigations(graph, "FailureMode", "fm_id").join(_implemented(graph), "control_id", "left_anti").distinct()
    ipar = graph.node("Document").filter("document_type = 'ipar'").select(F.col("id").alias("document_id"))
    identifies = graph.edge("IDENTIFIES").select(F.col("src").alias("document_id"), F.col("dst").alias("fm_id"))
    return (identifies.join(ipar, "document_id", "left_semi").join(open_controls, "fm_id")
            .select("document_id", "control_id").distinct())


@register_coverage_query("ipar-controls-coverage", _NEWEST,
                         "Controls of one IPAR document that no procedure step implements", ("documentId",))
def ipar_controls_coverage(graph: AuditGraph, documentId: str) -> DataFrame:
    gaps = ipar_control_gaps(graph).filter(F.col("document_id") == documentId).select(F.col("control_id").alias("id"))
    return graph.node("Control").join(gaps, "id", "left_semi").select("id", "control_type", "created_at")


def process_update_gaps(graph: AuditGraph) -> DataFrame:
    """(document, process) pairs where some identified, risk-bearing failure mode has neither itself
    nor that risk mitigated by a control the process's steps implement."""
    steps = graph.node("ProcedureStep").select(F.col("id").alias("src"), "process_id")
    operated = (graph.edge("IMPLEMENTS", src_label="ProcedureStep").join(steps, "src")
                .select("process_id", F.col("dst").alias("control_id")).distinct())
    covered_modes = operated.join(_mitigations(graph, "FailureMode", "fm_id"), "control_id").select("process_id", "fm_id").distinct()
    covered_risks = operated.join(_mitigations(graph, "Risk", "risk_id"), "control_id").select("process_id", "risk_id").distinct()
    related = graph.edge("RELATES_TO", dst_label="Process").select(
        F.col("src").alias("document_id"), F.col("dst").alias("process_id"))
    identifies = graph.edge("IDENTIFIES").select(F.col("src").alias("document_id"), F.col("dst").alias("fm_id"))
    implies = graph.edge("IMPLIES").select(F.col("src").alias("fm_id"), F.col("dst").alias("risk_id"))
    return (
        related.join(identifies, "document_id")
        .join(covered_modes, ["process_id", "fm_id"], "left_anti")
        .join(implies, "fm_id")
        .join(covered_risks, ["process_id", "risk_id"], "left_anti")
        .select("document_id", "process_id").distinct()
    )


@register_coverage_query("procedures-affected-by-ipar-update", ("name", "id"),
                         "Processes a document relates to whose steps leave one of its risks open", ("iparId",))
def procedures_affected_by_ipar_update(graph: AuditGraph, iparId: str) -> DataFrame:
    gaps = process_update_gaps(graph).filter(F.col("document_id") == iparId).select(F.col("process_id").alias("id"))
    return graph.node("Process").join(gaps, "id", "left_semi").select("id", "name", "version")
