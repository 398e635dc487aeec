"""Ingestion steps stay within the row of a document; versions follow the order of a key across blocks."""

import json
from datetime import datetime, timedelta

from riskloom.operators import ingest

RAW = "document_id string, model_used string, extracted_at timestamp_ntz, response string"
NONE = "id string, entity_type string, business_key string, fingerprint string"


def document(name, at, text, ref="FailureMode:A", section="S"):
    source = {"section": section}
    mode = {"entityType": "FailureMode", "properties": {"code": "A", "description": text}, "confidence": 0.9, "sourceReference": source}
    risk = {"entityType": "Risk", "properties": {"level": "LOW", "description": "r"}, "confidence": 0.9, "sourceReference": source}
    link = {"from": ref, "to": "Risk:any", "type": "IMPLIES", "confidence": 0.9, "sourceReference": source}
    return (name, "m", datetime(2024, 1, 1) + timedelta(days=at), json.dumps({"entities": [mode, risk], "relationships": [link]}))


def test_verdicts_shuffle_nothing_and_equal_those_over_rows(spark):
    raw = spark.createDataFrame([document("d1", 0, "x"), document("d2", 1, "x", ref="FailureMode:B"), document("d3", 2, "x", section=""),
                                 document("d4", 3, "x", ref="Risk"), ("d5", "m", datetime(2024, 1, 1), None)], RAW)
    judged = ingest.judged(raw).select("document_id", "valid", "error_count", "first_error")
    entities, relationships = ingest.parse_entities(raw), ingest.parse_relationships(raw)
    over_rows = ingest.document_verdicts(raw, ingest.validate_entities(entities), ingest.validate_relationships(relationships, entities))
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, judged.collect())) == sorted(map(tuple, over_rows.collect()))
    assert [r.valid for r in judged.orderBy("document_id").collect()] == [True, False, False, False, True]


def test_versions_of_one_key_over_many_blocks(spark):
    texts = ["abbbacca"[i % 8] for i in range(40)]
    raw = spark.createDataFrame([document(f"d{i:02}", i, text) for i, text in enumerate(texts)], RAW)
    rows = ingest.decisions(ingest.parse_entities(raw), spark.createDataFrame([], NONE)).filter("entity_type = 'FailureMode'")
    got = {r.document_id: r for r in rows.collect()}
    version = before = None
    for i, text in enumerate(texts):
        row = got[f"d{i:02}"]
        opens = i == 0 or text != texts[i - 1]
        if opens:
            version, before = row.entity_id, version
        assert row.entity_id == version and row.supersedes_id == (before if opens else None)
        assert row.action == (("created_version" if i else "created") if opens else "found_identical")
    assert len({r.entity_id for r in got.values()}) == sum(i == 0 or t != texts[i - 1] for i, t in enumerate(texts))
