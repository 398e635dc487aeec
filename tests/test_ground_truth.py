from riskloom.operators import evaluate as ev
from riskloom.operators.patterns import edge_ends, hops
from riskloom.sources.ground_truth import GROUND_TRUTH
from riskloom.sources.star_schema import load_graph
from tests.conftest import table


def test_one_read_a_label_finds_what_single_searches_find(tiny):
    together = ev.expected_entities(tiny)
    assert table(together) == table(ev.expected_entities(tiny, limit=1000))
    assert together.count() == len(table(together))
    found = table(together)
    # Question 11 asks for severe failure modes with a control, 14 for audits that use documents, 13 for findings on controls.
    assert {i for q, i in found if q == 11} == {"fm1"} and {i for q, i in found if q == 14} == {"a1"} and {i for q, i in found if q == 13} == {"f2"}
    assert {i for q, i in found if q == 5} == {"fm1", "fm2", "fm3"} and {i for q, i in found if q == 17} == {"fm1"}


def test_labels_are_read_once(tiny):
    labels = {row[2] for row in GROUND_TRUTH}
    plan = ev.expected_entities(tiny)._jdf.queryExecution().analyzed().toString()
    assert plan.count("explode(") <= len(labels)


def test_only_edges_that_can_answer_are_read(tiny):
    # A requirement is at neither end of a provenance edge, so question 4 reads none: the extractions are read for question 20 alone.
    asked = {row[0]: row for row in GROUND_TRUTH}[4]
    edge = {"type": asked[4][0], "direction": asked[4][1], "target_label": asked[4][2]}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan(edge_ends(tiny, edge, "Requirement")) and edge_ends(tiny, edge, "Extraction").count() > 0
    ends = edge_ends(tiny, {"type": "MITIGATES", "direction": "in", "target_label": "Control"}, "FailureMode")
    assert {r.id for r in ends.collect()} == {r.dst for r in tiny.edge("MITIGATES").collect() if r.dst_label == "FailureMode" and r.src_label == "Control"}


def test_hops_of_given_nodes(tiny):
    every = hops(tiny).select("id", "neighbour_id", "rel_type", "direction")
    for ids in (["d1", "c1"], ["fm1", "none"], []):
        found = hops(tiny, ids=ids).select("id", "neighbour_id", "rel_type", "direction")
        assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in every.collect() if r.id in ids)


def test_given_ids_reach_the_scans(spark):
    """The line items are narrowed before their pairs are made distinct."""
    graph = load_graph(spark, "/root/testdata/sf0.001")
    plan = hops(graph, ["IDENTIFIES"], ids=["doc-1", "doc-2"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.rindex("Filter") and "doc-" in plan[plan.rindex("Filter"):]
