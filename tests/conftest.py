from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from riskloom import AuditGraph, schemas  # noqa: E402
from riskloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def _edges(spark, rows):
    """rows: 'src REL dst' with labels taken from the id prefixes."""
    labels = {"d": "Document", "fm": "FailureMode", "r": "Risk", "c": "Control", "s": "ProcedureStep", "p": "Process", "a": "Audit", "f": "Finding"}
    label = lambda node: labels[node.rstrip("0123456789")]
    out = {}
    for row in rows:
        src, rel, dst = row.split()
        out.setdefault(rel, []).append((src, dst, rel, label(src), label(dst), 1.0, None, "CONFIRMED"))
    return {rel: spark.createDataFrame(items, schemas.EDGE) for rel, items in out.items()}


@pytest.fixture(scope="session")
def tiny(spark):
    """Two documents, three failure modes and risks, three controls (one orphan), two steps."""
    node = lambda cols, rows: spark.createDataFrame(rows, cols)
    ts = "created_at timestamp_ntz"
    from datetime import datetime
    day = datetime(2024, 1, 1)
    nodes = {
        "Document": node(f"id string, {ts}, uploaded_at timestamp_ntz, document_type string, file_name string, status string",
                         [("d1", day, day, "ipar", "Safety ST 0007 rev.pdf", "PROCESSED"), ("d2", day, day, "fmea", "st 1234.pdf", "failed")]),
        "FailureMode": node(f"id string, {ts}, code string, rpn int, severity int, description string",
                            [("fm1", day, "A", 300, 9, "Fall hazard"), ("fm2", day, "B", 60, 3, "slip"), ("fm3", day, "C", None, 5, "cut")]),
        "Risk": node(f"id string, {ts}, level string", [("r1", day, "CRITICAL"), ("r2", day, "LOW"), ("r3", day, "HIGH")]),
        "Control": node(f"id string, {ts}, control_type string, effectiveness double",
                        [("c1", day, "PREVENTIVE", 90.0), ("c2", day, "PREVENTIVE", 40.0), ("c3", day, "DETECTIVE", None)]),
        "ProcedureStep": node(f"id string, {ts}, process_id string", [("s1", day, "p1"), ("s2", day, "p9")]),
        "Process": node(f"id string, {ts}, name string, version string", [("p1", day, "Weld", "1.0"), ("p2", day, "Cut", "1.0")]),
        "Audit": node(f"id string, {ts}", [("a1", day)]),
        "Finding": node(f"id string, {ts}, updated_at timestamp_ntz, status string, priority string",
                        [("f1", day, datetime(2024, 3, 1), "RESOLVED", "HIGH"), ("f2", day, day, "OPEN", "LOW")]),
    }
    edges = _edges(spark, [
        "d1 IDENTIFIES fm1", "d1 IDENTIFIES fm2", "d2 IDENTIFIES fm1",
        "fm1 IMPLIES r1", "fm2 IMPLIES r1", "fm2 IMPLIES r2",
        "c1 MITIGATES fm1", "c2 MITIGATES fm1", "c1 MITIGATES r2",
        "s1 IMPLEMENTS c1", "d1 RELATES_TO p1", "d1 RELATES_TO p2",
        "a1 USES d1", "a1 EVALUATES p1", "f2 REFERENCES c1", "f1 ADDRESSES fm1",
        "fm2 SUPERSEDES fm1", "fm3 SUPERSEDES fm2",
    ])
    ext = [(f"x{i}", entity, label, doc, "m", day, 0.9, "Sec", 1, 0 if i == 1 else 3, 5) for i, (entity, label, doc) in enumerate(
        [("c1", "Control", "d1"), ("c1", "Control", "d2"), ("c2", "Control", "d2"), ("r3", "Risk", "d1"), ("fm1", "FailureMode", "d1")])]
    return AuditGraph(spark, nodes, edges, extractions=spark.createDataFrame(ext, schemas.EXTRACTION),
                      chunks=spark.createDataFrame([], schemas.CHUNK_SCHEMA))


def table(df, *columns):
    """Rows as a set of tuples of the chosen columns."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return {tuple(r) for r in rows}


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()
