"""A sample of registered queries against their SQL answers; check_oracle.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ("a01_risk_exposure", "a10_process_health", "a13_document_coverage", "a14_shared_entity_network", "c06_process_update_gaps",
          "d08_audit_summary", "g04_graph_pattern", "i08_document_verdicts", "t05_segment_ipar", "t15_fixed_size_chunks", "e04_token_overlap")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_answer_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, want)
