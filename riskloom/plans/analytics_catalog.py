"""Registered analytics, coverage and diagnostic queries over the star-schema graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.graph import AuditGraph
from riskloom.operators import coverage as cov
from riskloom.operators import crossdoc as xd
from riskloom.operators import diagnostics as dx
from riskloom.operators import portfolio as pf
from riskloom.plans.analytics_sql import AS_OF
from riskloom.sources.star_schema import load_graph

Query = Callable[[SparkSession, str], DataFrame]


def on_graph(query: Callable[[AuditGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(load_graph(spark, sf_dir))


def gap_counts(graph: AuditGraph) -> DataFrame:
    """Size of every coverage gap, before any report limit."""
    gaps = {
        "risks-without-controls": cov.risks_without_controls(graph),
        "controls-without-steps": cov.controls_without_steps(graph),
        "unmitigated-high-rpn": cov.unmitigated_high_rpn(graph),
        "risks-without-procedure-controls": cov.risks_without_procedure_controls(graph),
        "ipar-controls-coverage": cov.ipar_control_gaps(graph),
        "procedures-affected-by-ipar-update": cov.process_update_gaps(graph),
    }
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("query"), F.count(F.lit(1)).alias("gaps")) for name, df in gaps.items()])


QUERIES: dict[str, Query] = {
    "a01_risk_exposure": on_graph(pf.risk_exposure),
    "a01_unmitigated_critical_risks": on_graph(pf.unmitigated_critical_risks),
    "a02_risk_trends": on_graph(pf.risk_trends),
    "a03_control_effectiveness": on_graph(pf.control_effectiveness),
    "a03_control_facts": on_graph(pf.control_facts),
    "a04_control_coverage": on_graph(pf.control_coverage),
    "a05_failure_mode_analysis": on_graph(pf.failure_mode_analysis),
    "a05_unmitigated_critical_failure_modes": on_graph(pf.unmitigated_critical_failure_modes),
    "a06_finding_trends": on_graph(pf.finding_trends),
    "a07_finding_resolution": on_graph(lambda g: pf.finding_resolution(g, AS_OF)),
    "a08_finding_resolution_trends": on_graph(pf.finding_resolution_trends),
    "a09_compliance_status": on_graph(pf.compliance_status),
    "a09_compliance_gaps": on_graph(pf.compliance_gaps),
    "a10_process_health": on_graph(pf.process_health),
    "a10_process_summary": on_graph(pf.process_summary),
    "a10_process_versions": on_graph(pf.process_versions),
    "a11_portfolio": on_graph(lambda g: pf.portfolio(g, AS_OF)),
    "a12_cross_document_entities": on_graph(xd.cross_document_entities),
    "a12_cross_document_links": on_graph(xd.cross_document_links),
    "a12_cross_document_types": on_graph(xd.cross_document_types),
    "a13_document_coverage": on_graph(xd.document_coverage),
    "a13_document_coverage_totals": on_graph(xd.document_coverage_totals),
    "a13_document_coverage_items": on_graph(xd.document_coverage_items),
    "a14_shared_entity_network": on_graph(xd.shared_memberships),
    "a14_entity_links": on_graph(xd.entity_links),
    "a14_document_neighbours": on_graph(lambda g: xd.document_neighbours(g, g.node("Document").agg(F.min("id").alias("document_id")))),
    "a15_document_connections": on_graph(xd.document_connections),
    "a16_entity_provenance": on_graph(xd.entity_provenance),
    "a17_fps_maturity": on_graph(xd.fps_maturity),
    "a18_standard_maturity": on_graph(xd.standard_maturity),
    "c01_risks_without_controls": on_graph(lambda g: cov.coverage("risks-without-controls", g)),
    "c02_controls_without_steps": on_graph(lambda g: cov.coverage("controls-without-steps", g)),
    "c03_unmitigated_high_rpn": on_graph(lambda g: cov.coverage("unmitigated-high-rpn", g)),
    "c04_risks_without_procedure_controls": on_graph(lambda g: cov.coverage("risks-without-procedure-controls", g)),
    "c05_ipar_control_gaps": on_graph(cov.ipar_control_gaps),
    "c06_process_update_gaps": on_graph(cov.process_update_gaps),
    "c_gap_counts": on_graph(gap_counts),
    "d01_control_connectivity": on_graph(dx.control_connectivity),
    "d02_risk_connectivity": on_graph(dx.risk_connectivity),
    "d03_failure_mode_connectivity": on_graph(dx.failure_mode_connectivity),
    "d04_requirement_connectivity": on_graph(dx.requirement_connectivity),
    "d05_process_connectivity": on_graph(dx.process_connectivity),
    "d06_relationship_counts": on_graph(dx.relationship_counts),
    "d07_audit_summary_served": on_graph(lambda g: dx.audit_summary(g, all_findings=True)),
    "d08_audit_summary": on_graph(dx.audit_summary),
    "d08_audit_documents": on_graph(dx.audit_documents),
    "d09_audit_relationship_stats": on_graph(dx.audit_relationship_stats),
    "d10_ontology_stats": on_graph(dx.ontology_stats),
}
