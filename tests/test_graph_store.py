"""Ingestion by batches into a stored graph."""

import json
from collections import Counter
from datetime import datetime

from riskloom.operators import graph_store as gs
from riskloom.operators import records as rec


def response(code, severity, control="guard", section="S1", extra=()):
    source = {"section": section, "pageNumber": 2, "lineRange": [3, 4]}
    entity = lambda kind, **p: {"entityType": kind, "properties": p, "confidence": 0.9, "sourceReference": source}
    relation = lambda a, b, kind, **p: {"from": a, "to": b, "type": kind, "confidence": 0.8, "properties": p, "sourceReference": source}
    return json.dumps({"entities": [entity("FailureMode", code=code, description="d", severity=str(severity)),
                                    entity("Control", controlType="PREVENTIVE", description=control, effectiveness="high"), *extra],
                       "relationships": [relation(f"Control:{control}", f"FailureMode:{code}", "MITIGATES", strength="7"),
                                         relation(f"Control:{control}", f"FailureMode:{code}", "MITIGATES"),
                                         relation("Control:gone", f"FailureMode:{code}", "MITIGATES")][:2]})


def raw(spark, *rows):
    return spark.createDataFrame([(d, "m1", datetime(2024, 1, day), r) for d, day, r in rows],
                                 "document_id string, model_used string, extracted_at timestamp_ntz, response string")


def content(store):
    return Counter(map(tuple, gs.graph_rows(store.graph()).collect()))


def test_batches_versions_and_replays(spark, tmp_path):
    store = gs.GraphStore(spark, str(tmp_path / "graph"))
    assert store.batches() == [] and sum(content(store).values()) == 0
    first = raw(spark, ("d1", 1, response("A", 5)), ("d2", 2, response("B", 1, section="")), ("d3", 3, None))
    assert store.ingest("b1", first)
    graph = store.graph()
    assert {(r.id, r.status) for r in graph.node("Document").collect()} == {("d1", "PROCESSED"), ("d2", "FAILED"), ("d3", "PENDING")}
    mode, = graph.node("FailureMode").collect()
    assert (mode.code, mode.severity, mode.rpn) == ("A", 5, None)
    control, = graph.node("Control").collect()
    assert control.effectiveness is None and control.control_type == "PREVENTIVE"  # a word is no number
    edges = graph.edge("MITIGATES").collect()
    assert len(edges) == 2 and {e.properties.get("strength") for e in edges} == {"7", None} and all(e.extraction_id for e in edges)
    assert [(e.src, e.dst) for e in graph.edge("IDENTIFIES").collect()] == [("d1", mode.id)]
    one = content(store)
    assert not store.ingest("b1", first) and content(store) == one
    assert store.ingest("b1 under another id", first) and content(store) == one
    # another content is a version, the same content in another document is none but adds its record; a failed document is mended
    assert store.ingest("b2", raw(spark, ("d4", 4, response("A", 6)), ("d5", 5, response("A", 6)), ("d2", 6, response("B", 1))))
    graph = store.graph()
    modes = {r.id: r.severity for r in graph.node("FailureMode").filter("code = 'A'").collect()}
    assert sorted(modes.values()) == [5, 6]
    (e,) = graph.edge("SUPERSEDES").collect()
    assert (modes[e.src], modes[e.dst], e.properties) == (6, 5, {"reason": "Property changes detected"})
    assert {r.id: r.status for r in graph.node("Document").collect()}["d2"] == "PROCESSED"
    assert graph.extractions.filter(f"entity_id = '{e.src}'").count() == 2
    sources = rec.get_relationships(graph, graph.node("FailureMode").filter("code = 'A'").select("id"), rel_types=("MITIGATES",)).collect()
    assert len(sources) == 6 and all((s.section, s.page_number) == ("S1", 2) for s in sources)
    assert store.log().count() == 9


def test_a_batch_without_manifest_is_not_seen_and_can_be_done_again(spark, tmp_path, monkeypatch):
    store = gs.GraphStore(spark, str(tmp_path / "graph"))
    rows = raw(spark, ("d1", 1, response("A", 5)))
    with monkeypatch.context() as broken:
        broken.setattr(store, "_commit", lambda *_: 1 / 0)  # all tables are written, the manifest is not
        try:
            store.ingest("b1", rows)
            raise AssertionError
        except ZeroDivisionError:
            pass
    assert store.batches() == [] and sum(content(store).values()) == 0
    assert store.ingest("b1", rows)
    whole = gs.GraphStore(spark, str(tmp_path / "other"))
    whole.ingest("x", rows)
    assert content(store) == content(whole)


def test_purge_and_chunks(spark, tmp_path):
    store = gs.GraphStore(spark, str(tmp_path / "graph"))
    chunk = spark.createDataFrame([(f"k{d}", None, d, d, "text", 0, None, None, 1, False, 0, 0, 4, "fmea", "x") for d in ("d1", "d2")],
                                  ", ".join([gs.schemas.CHUNK_SCHEMA, "other string"]))
    rows = raw(spark, ("d1", 1, response("A", 5)), ("d2", 1, response("B", 1, section="")))
    given = spark.createDataFrame([("d1", "a.pdf", "fmea")], "id string, file_name string, document_type string")
    for batch in ("b1", "b2"):
        store.ingest(batch, rows, documents=given, chunks=chunk)
    assert [r.id for r in store.graph().chunks.collect()] == ["kd1"]
    assert [(r.file_name, r.document_type) for r in store.graph().node("Document").filter("id = 'd1'").collect()] == [("a.pdf", "fmea")]
    assert store.purge("p0", "2024-01-01T12:00:00") == 0
    assert store.purge("p1", "2024-02-01") == 1 and store.purge("p1", "2024-02-01") == 0
    assert [r.id for r in store.graph().node("Document").collect()] == ["d1"]
    before = content(store)
    store.ingest("b3", raw(spark, ("d2", 9, response("B", 1))))
    assert {r.id for r in store.graph().node("Document").collect()} == {"d1", "d2"}
    assert not before - content(store)


def test_only_batches_with_known_documents_look_them_up(spark, tmp_path, monkeypatch):
    store = gs.GraphStore(spark, str(tmp_path / "graph"))
    calls, resolve = [], gs.GraphStore._resolved_tables
    monkeypatch.setattr(gs.GraphStore, "_resolved_tables", lambda self, passed, seen, again: calls.append(again) or resolve(self, passed, seen, again))
    first, other = raw(spark, ("d1", 1, response("A", 5)), ("d2", 2, response("B", 1, section=""))), raw(spark, ("d3", 3, response("A", 6)))
    store.ingest("b1", first)
    store.ingest("b2", other)
    two = content(store)
    assert calls == [False, False]
    # Nothing new: no resolution, and only the log and the failed document are written.
    store.ingest("b3", first)
    assert calls == [False, False] and content(store) == two and set(store.batches()[-1][2]) == {"log", "nodes/Document"}
    # One document of two is known: what the other brings is added as if it came alone.
    store.ingest("b4", first.unionByName(raw(spark, ("d4", 4, response("C", 2)))))
    alone = gs.GraphStore(spark, str(tmp_path / "alone"))
    for batch, rows in (("b1", first), ("b2", other), ("b4", raw(spark, ("d4", 4, response("C", 2))))):
        alone.ingest(batch, rows)
    assert calls[:3] == [False, False, True] and content(store) == content(alone) and content(store) != two
