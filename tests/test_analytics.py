import pytest
from pyspark.sql import functions as F

from conftest import one, table
from riskloom.operators import coverage as cov
from riskloom.operators import crossdoc as xd
from riskloom.operators import diagnostics as dx
from riskloom.operators import portfolio as pf
from riskloom.sources.star_schema import load_graph


def test_risk_exposure_counts_risks_and_joined_rows(tiny):
    rows = {r.level: r for r in pf.risk_exposure(tiny).collect()}
    assert set(rows) == {"LOW", "MEDIUM", "HIGH", "CRITICAL", "TOTAL"}
    # r1 is reached through fm1 (two controls) and fm2 (none): three joined rows, one of them open.
    assert (rows["CRITICAL"].risks, rows["CRITICAL"].row_risks, rows["CRITICAL"].row_unmitigated, rows["CRITICAL"].unmitigated) == (1, 3, 1, 0)
    assert rows["MEDIUM"].risks == 0
    assert (rows["TOTAL"].implied, rows["TOTAL"].explicit, rows["TOTAL"].unmitigated) == (2, 1, 2)
    assert sum(rows[k].risks for k in rows if k != "TOTAL") == rows["TOTAL"].risks == 3


def test_control_figures(tiny):
    rows = {r.control_type: r for r in pf.control_effectiveness(tiny).collect()}
    assert (rows["PREVENTIVE"].controls, rows["PREVENTIVE"].avg_effectiveness) == (2, 65.0)
    assert (rows["TOTAL"].high_effectiveness, rows["TOTAL"].low_effectiveness, rows["TOTAL"].with_steps) == (1, 1, 1)
    assert rows["DETECTIVE"].avg_effectiveness == 0.0 and rows["CORRECTIVE"].controls == 0
    cover = one(pf.control_coverage(tiny))
    assert (cover["total_risks"], cover["risks_covered"], cover["row_risks_covered"]) == (3, 1, 2)
    assert cover["coverage_percentage"] == 33.33


def test_failure_modes_and_findings(tiny):
    rows = {r.rpn_bucket: r for r in pf.failure_mode_analysis(tiny).collect()}
    assert (rows["critical"].failure_modes, rows["medium"].unmitigated, rows["unknown"].failure_modes) == (1, 1, 1)
    assert rows["TOTAL"].mitigation_coverage == 33.33
    resolution = one(pf.finding_resolution(tiny, "2024-03-15"))
    assert (resolution["last_30_days"], resolution["all_time"], resolution["average_resolution_days"]) == (100.0, 50.0, 60.0)


def test_process_health(tiny):
    rows = {r.process_id: r for r in pf.process_health(tiny).collect()}
    assert (rows["p1"].procedure_steps, rows["p1"].critical_risks) == (1, 1)
    assert (rows["p2"].has_procedures, rows["p2"].critical_risks) == (False, 0)


def test_cross_document_and_network(tiny):
    assert table(xd.cross_document_entities(tiny), "entity_id", "document_count", "row_document_count") == {
        ("c1", 2, 2), ("fm1", 2, 3)}


def test_network_is_exact(spark, tiny):
    # Shared: fm1 (identified), r1 (implied), c1 (extracted); r2's only control is the same on both sides.
    links = {(r, e): (n, k) for r, e, n, k in table(xd.entity_links(tiny), "route", "entity_id", "documents", "links")}
    assert {key: v for key, v in links.items() if v[0] > 1} == {
        ("identified", "fm1"): (2, 1), ("implied_risk", "r1"): (2, 1), ("controls", "r2"): (2, 0), ("extracted", "c1"): (2, 1)}
    per_document = {r.document_id: r.connection_count for r in xd.document_connections(tiny).collect()}
    assert per_document == {"d1": 3, "d2": 3}
    assert sum(k for _, k in links.values()) * 2 == sum(per_document.values())
    around = xd.document_neighbours(tiny, spark.createDataFrame([("d1",)], "document_id string"))
    assert table(around) == {("d1", "d2", 3, 3)}


def test_network_sums_agree_on_the_star_schema(spark):
    graph = load_graph(spark, "/root/testdata/sf0.001")
    links = xd.entity_links(graph).agg(F.sum("links")).first()[0]
    assert links > 0 and links * 2 == xd.document_connections(graph).agg(F.sum("connection_count")).first()[0]


def test_document_coverage(tiny):
    rows = {r.document_id: r for r in xd.document_coverage(tiny).collect()}
    # d1: risks r1 and r2 through failure modes, r2 again through c1, r3 extracted.
    assert (rows["d1"].risk_count, rows["d1"].row_risk_count, rows["d1"].control_count, rows["d1"].row_control_count) == (3, 4, 2, 3)
    assert (rows["d1"].failure_mode_count, rows["d1"].extracted_entity_count) == (2, 3)


def test_maturity(tiny):
    rows = {r.document_id: r for r in xd.fps_maturity(tiny).collect()}
    assert (rows["d1"].total_procedures, rows["d1"].audited_procedures, rows["d1"].non_compliant_count) == (1, 2, 2)
    assert xd.fps_maturity(tiny, reference_mode=True).filter("document_id = 'd2'").first().audited_procedures == 3
    assert table(xd.standard_maturity(tiny), "standard_code") == {("ST007",), ("ST1234",)}
    with pytest.raises(LookupError):
        xd.entity_provenance(tiny, "nobody")


def test_coverage_queries(tiny):
    assert table(cov.coverage("risks-without-controls", tiny), "id") == {("r1",), ("r3",)}
    assert table(cov.coverage("controls-without-steps", tiny), "id") == {("c2",), ("c3",)}
    assert cov.coverage("unmitigated-high-rpn", tiny, threshold=50).select("id").collect()[0].id == "fm2"
    assert table(cov.coverage("risks-without-procedure-controls", tiny), "id") == {("r3",)}
    assert table(cov.coverage("ipar-controls-coverage", tiny, documentId="d1"), "id") == {("c2",)}
    # p1 operates c1, which covers fm1 and r2 but not the pair (fm2, r1); p2 operates nothing.
    assert table(cov.coverage("procedures-affected-by-ipar-update", tiny, iparId="d1"), "id") == {("p1",), ("p2",)}
    with pytest.raises(ValueError):
        cov.coverage("ipar-controls-coverage", tiny)
    with pytest.raises(ValueError):
        cov.coverage("no-such-query", tiny)
    assert len(cov.available_coverage_queries()) == 6


def test_diagnostics(tiny):
    assert one(dx.control_connectivity(tiny)) == {
        "total_controls": 3, "controls_linked_to_risks": 1, "controls_linked_to_failure_modes": 2, "orphaned_controls": 1}
    assert one(dx.risk_connectivity(tiny)) == {
        "total_risks": 3, "risks_with_direct_controls": 1, "risks_with_indirect_controls": 1, "unmitigated_risks": 1, "standalone_risks": 1}
    assert one(dx.process_connectivity(tiny))["processes_with_steps"] == 1
    assert one(dx.process_connectivity(tiny, key="name_version"))["processes_with_steps"] == 0
    summary = one(dx.audit_summary(tiny))
    assert (summary["failure_modes"], summary["high_risks"], summary["controls"], summary["findings"]) == (2, 1, 2, 1)
    assert one(dx.audit_summary(tiny, all_findings=True))["findings"] == 2
    assert table(dx.audit_relationship_stats(tiny)) == {("a1", "2->2", "2->2")}


def test_network_counts_read_each_route_once(spark):
    """One pass over the memberships for the links of entities, no second join of them for those of documents; rows that are distinct already are not made so again."""
    graph = load_graph(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    reads = lambda df: plan(df).count("Relation [l_orderkey")
    assert reads(xd.entity_links(graph)) == reads(xd.shared_memberships(graph))
    assert "LeftOuter" not in plan(xd.document_connections(graph))
    assert plan(xd.extracted(graph)).count("Aggregate") == 3  # one for each kind of entity
