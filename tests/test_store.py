from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import one, table
from riskloom import AuditGraph
from riskloom.functions.filters import matches
from riskloom.operators import classify, ingest, patterns, records, vector_index, vectors
from riskloom.sources import files


def test_folder_scan_and_texts(spark, tmp_path):
    for name in ("b.txt", "a.CSV", "skip.md"):
        (tmp_path / name).write_text("olá\nmundo", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("x")
    assert [r.name for r in files.scan_folder(spark, str(tmp_path)).collect()] == ["a.CSV", "b.txt"]
    assert files.read_texts(spark, str(tmp_path / "b.txt")).first().text == "olá\nmundo"


def test_graph_round_trip(spark, tiny, tmp_path):
    tiny.edges().write.partitionBy("rel_type").parquet(str(tmp_path / "edges"))
    stored = AuditGraph.read(spark, str(tmp_path))
    assert stored.edge("IMPLIES").count() == 3
    assert "PartitionFilters: [isnotnull(rel_type" in stored.edge("IMPLIES")._jdf.queryExecution().toString()


def test_updates_and_deletes(spark, tiny):
    nodes = tiny.node("Finding")
    new = spark.createDataFrame([("f2", "CLOSED")], "id string, status string")
    rows = {r.id: r for r in records.update_entities(nodes, new, "2025-01-01").collect()}
    assert (rows["f2"].status, rows["f2"].priority, rows["f2"].updated_at) == ("CLOSED", "LOW", datetime(2025, 1, 1))
    assert rows["f1"].updated_at == datetime(2024, 3, 1)
    gone = spark.createDataFrame([("fm1",)], "id string")
    assert records.detach(tiny.edges(), gone).filter("src = 'fm1' or dst = 'fm1'").isEmpty()


def test_relationship_creation_needs_both_ends(spark, tiny):
    rows = spark.createDataFrame([("c3", "r3", "MITIGATES", 0.8), ("c3", "gone", "MITIGATES", 0.8)], "src string, dst string, rel_type string, confidence double")
    assert table(records.create_relationships(tiny, rows), "src", "dst", "src_label", "dst_label") == {("c3", "r3", "Control", "Risk")}


def chunks(spark):
    rows = [("k1", [1.0, 0.0], "d1", 0, "a"), ("k2", [1.0, 1.0], "d1", 1, "b"), ("k3", [0.0, 1.0], "d2", 0, "c"), ("k4", [2.0, 0.0], "d2", 1, "d")]
    return spark.createDataFrame(rows, "id string, embedding array<float>, document_id string, chunk_index int, chunk_text string").withColumn("document_type", F.lit("fps"))


def test_vector_search_ranks_and_breaks_ties_by_id(spark, tmp_path):
    got = vectors.vector_search(chunks(spark), [1.0, 0.0], 3).collect()
    assert [(r.id, round(r.score, 4)) for r in got] == [("k1", 1.0), ("k4", 1.0), ("k2", 0.7071)]
    assert [r.id for r in vectors.vector_search(chunks(spark), [1.0, 0.0], 5, {"document_id": "d2"}).collect()] == ["k4", "k3"]
    many = vectors.search_many(chunks(spark), {7: [1.0, 0.0], 8: [0.0, 1.0]}, 1)
    assert table(many, "question_id", "chunk_id") == {(7, "k1"), (8, "k3")}
    asked = chunks(spark).filter("id = 'k3'").select(F.lit("q").alias("question_id"), "document_id", "embedding")
    assert [r.chunk_id for r in vectors.nearest_chunks(asked, chunks(spark), 2).orderBy("rank").collect()] == ["k3", "k4"]
    index = vector_index.build(chunks(spark), str(tmp_path / "index"))
    near = {r.id for r in vector_index.search(index, [1.0, 0.0], 2).collect()}
    assert near == {"k1", "k4"}


def test_chunk_store(spark, tmp_path):
    new = chunks(spark).filter("id = 'k1'").withColumn("chunk_text", F.lit("A"))
    merged = records.upsert(chunks(spark), new)
    assert merged.count() == 4 and merged.filter("id = 'k1'").first().chunk_text == "A"
    assert records.migrate_chunks(chunks(spark), str(tmp_path / "copy")).first().copied == 4
    assert table(records.rebuild_documents(chunks(spark)), "document_id", "content") == {("d1", "a\n\n---\n\nb"), ("d2", "c\n\n---\n\nd")}
    assert records.rebuild_documents(chunks(spark), part_chunks=1).count() == 4


def test_filters(spark, tiny):
    ids = lambda f: {r.id for r in tiny.node("FailureMode").filter(matches(f)).collect()}
    assert ids({"rpn": {"$gte": 60, "$lt": 300}}) == {"fm2"}
    assert ids({"description": {"$contains": "FALL"}}) == {"fm1"} and ids({"severity": {"$in": [3, 5]}}) == {"fm2", "fm3"}
    with pytest.raises(ValueError):
        matches({"rpn": {"$near": 1}})


def test_versions(spark, tiny):
    assert table(patterns.version_chains(tiny, "FailureMode")) == {("fm1", "fm3", 2), ("fm2", "fm3", 1), ("fm3", "fm3", 0)}
    assert table(patterns.latest_versions(tiny, "FailureMode"), "id") == {("fm3",)}
    assert patterns.find_latest(tiny, "FailureMode", code="A").isEmpty()
    assert patterns.find_latest(tiny, "FailureMode", code="C").first().id == "fm3"


def test_version_cycle_is_an_error(spark, tiny):
    looped = AuditGraph(spark, {"FailureMode": tiny.node("FailureMode")}, {"SUPERSEDES": tiny.edge("SUPERSEDES").unionByName(
        tiny.edge("SUPERSEDES").limit(1).withColumns({"src": F.lit("fm1"), "dst": F.lit("fm3")}))})
    patterns.MAX_DOUBLINGS, saved = 4, patterns.MAX_DOUBLINGS
    try:
        with pytest.raises(ValueError):
            patterns.version_chains(looped, "FailureMode")
    finally:
        patterns.MAX_DOUBLINGS = saved


def test_reachable_keeps_the_least_depth(spark, tiny):
    seeds = spark.createDataFrame([("r1",)], "id string")
    rows = {r.id: r.depth for r in patterns.reachable(tiny, seeds, 2).collect()}
    assert rows["fm1"] == 1 and rows["fm2"] == 1 and rows["c1"] == 2 and "r1" not in {k for k, d in rows.items() if d == 1}


def extraction(document, entities, relationships=()):
    import json
    source = {"section": "S"}
    body = {"entities": [{"entityType": t, "properties": p, "confidence": c, "sourceReference": source} for t, p, c in entities]}
    if relationships:
        body["relationships"] = [{"from": a, "to": b, "type": t, "confidence": 0.9, "sourceReference": source} for a, b, t in relationships]
    return (document, "m", datetime(2024, 1, 1), json.dumps(body))


def test_ingestion_versions_and_is_idempotent(spark):
    raw = spark.createDataFrame([
        extraction("d1", [("FailureMode", {"code": "A", "description": "one"}, 0.9), ("Risk", {"level": "LOW", "description": "r"}, 0.9)],
                   [("FailureMode:A", "Risk:r", "IMPLIES"), ("Document:x", "FailureMode:A", "IDENTIFIES")]),
        extraction("d2", [("FailureMode", {"description": "two", "code": "A"}, 0.9)]),
        extraction("d3", [("FailureMode", {"code": "A", "description": "one"}, 0.9)]),
        extraction("d4", [("FailureMode", {"code": "Z"}, 0.2)]),
    ], "document_id string, model_used string, extracted_at timestamp_ntz, response string")
    entities, relationships = ingest.parse_entities(raw), ingest.parse_relationships(raw)
    verdicts = ingest.document_verdicts(raw, ingest.validate_entities(entities), ingest.validate_relationships(relationships, entities))
    assert table(verdicts, "document_id", "valid") == {("d1", True), ("d2", True), ("d3", True), ("d4", False)}
    assert verdicts.filter("not valid").first().first_error == "confidence below threshold"
    good = ingest.accepted(entities, verdicts)
    none = spark.createDataFrame([], "id string, entity_type string, business_key string, fingerprint string")
    first = ingest.resolve_entities(good, none)
    assert table(first.filter("entity_type = 'FailureMode'"), "document_id", "action") == {("d1", "created"), ("d2", "created_version"), ("d3", "created_version")}
    assert ingest.supersedes_edges(first).count() == 2
    references = ingest.entity_references(first)
    linked = ingest.resolve_relationships(ingest.accepted(relationships, verdicts), references)
    assert [r.rel_type for r in linked.collect()] == ["IMPLIES"]
    assert ingest.implicit_edges(references).count() == 3
    latest = first.filter("document_id = 'd2'").select(F.col("entity_id").alias("id"), "entity_type", "business_key", "fingerprint")
    again = ingest.resolve_entities(good.filter("document_id = 'd2'"), latest)
    assert [(r.action, r.entity_id) for r in again.collect()] == [("found_identical", latest.first().id)]
    kept = first.filter("action <> 'found_identical' and entity_type = 'FailureMode'").select(
        F.col("entity_id").alias("id"), "entity_type", "business_key", "fingerprint", (F.col("document_id") == "d3").alias("is_latest"))
    repeated = ingest.resolve_entities(good, kept).filter("entity_type = 'FailureMode'")
    assert {r.action for r in repeated.collect()} == {"found_identical"} and ingest.supersedes_edges(repeated).isEmpty()
    assert table(repeated, "document_id", "entity_id") == table(first.filter("entity_type = 'FailureMode'"), "document_id", "entity_id")


def test_known_extractions_open_no_version(spark):
    raw = spark.createDataFrame([extraction(d, [("FailureMode", {"code": "A", "description": text}, 0.9)]) for d, text in (("d1", "one"), ("d2", "one"), ("d3", "two"))],
                                "document_id string, model_used string, extracted_at timestamp_ntz, response string")
    entities = ingest.parse_entities(raw)
    none = spark.createDataFrame([], "id string, entity_type string, business_key string, fingerprint string")
    first = ingest.resolve_entities(entities, none)
    assert table(first, "document_id", "action") == {("d1", "created"), ("d2", "found_identical"), ("d3", "created_version")}
    stored = first.filter("action <> 'found_identical'").select(
        F.col("entity_id").alias("id"), "entity_type", "business_key", "fingerprint", (F.col("document_id") == "d3").alias("is_latest"))
    again = ingest.resolve_entities(entities.filter("document_id = 'd2'"), stored, first.select("document_id", "ordinal", "entity_id"))
    assert table(again, "document_id", "action", "entity_id") == {("d2", "found_identical", first.filter("document_id = 'd1'").first().entity_id)}


def test_relationship_rules(spark):
    raw = spark.createDataFrame([extraction("d", [("FailureMode", {"code": "A", "description": "x"}, 0.9), ("Risk", {"level": "LOW", "description": "r"}, 0.9)],
                                            [("Risk:r", "FailureMode:A", "IMPLIES"), ("FailureMode:B", "Risk:r", "IMPLIES"), ("FailureMode:A", "Risk:any", "HOLDS")])],
                                "document_id string, model_used string, extracted_at timestamp_ntz, response string")
    rows = ingest.validate_relationships(ingest.parse_relationships(raw), ingest.parse_entities(raw)).orderBy("ordinal").collect()
    assert [r.errors for r in rows] == [["relationship not allowed"], ["unresolved reference"], ["invalid relationship type"]]


def test_missing_embedding_fails_the_load(spark):
    rows = chunks(spark).drop("embedding")
    with pytest.raises(Exception, match="No embedding"):
        ingest.attach_embeddings(rows, chunks(spark).filter("id <> 'k2'")).collect()


def test_classifier(spark):
    rows = spark.createDataFrame([("HIRA plan.pdf", "A risk assessment"), ("fmea.xlsx", "Modo de falha"), ("x.txt", "nothing"), ("fps and hira", "")], "name string, text string")
    got = [(r.document_type, round(r.confidence, 2)) for r in classify.classify(rows).collect()]
    assert got == [("hira", 0.96), ("fmea", 0.8), ("generic", 0.3), ("hira", 0.6)]
    assert classify.classify(rows, preview_chars=5).collect()[1].confidence == 0.5


def test_provenance_range_needs_both_ends(tiny):
    rows = {r.extraction_id: r.line_start for r in patterns.with_provenance(tiny, tiny.node("Control").select("id")).collect() if r.extraction_id}
    assert rows == {"x0": 3, "x1": None, "x2": 3}
