import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.operators import keyed_table, records
from riskloom.operators.keyed_table import KeyedTable
from tests.conftest import table

SCHEMA = "id string, text string, n int"


def files(path):
    """Data files with size and time of change."""
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                stat = os.stat(os.path.join(folder, name))
                found[os.path.join(folder, name)] = (stat.st_size, stat.st_mtime_ns)
    return found


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_table, "BUCKET_ROWS", 50)
    start = spark.createDataFrame([(f"k{i}", f"t{i}", i) for i in range(1000)], SCHEMA)
    made = KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert made.rows().count() == 0 and made.upsert(start.limit(0)) == [] and made.delete(start.select("id")) == []
    assert len(made.upsert(start)) == made.buckets == 20
    return made, start


def test_changes_touch_their_buckets_only(spark, stored):
    made, start = stored
    before = files(made.path)
    new = spark.createDataFrame([("k1", "changed", 1), ("k1", "changed", 0), ("new", None, None)], SCHEMA)
    touched = made.upsert(new, F.col("n"))
    assert 1 <= len(touched) <= 2
    after = files(made.path)
    assert {k: after[k] for k in before} == before
    assert {p.split("_bucket=")[1].split("/")[0] for p in set(after) - set(before)} == set(map(str, touched))
    expected = records.upsert(start, new.filter("n = 1 OR n IS NULL"))
    assert table(made.rows()) == table(expected) and made.rows().count() == 1001

    assert made.update(spark.createDataFrame([("k2", 7), ("nobody", 8)], "id string, n int"))
    assert table(made.get(spark.createDataFrame([("k2",), ("k2",), ("nobody",)], "id string"))) == {("k2", "t2", 7)}
    gone = spark.createDataFrame([(f"k{i}",) for i in range(3)] + [(None,)], "id string")
    made.delete(gone)
    again = KeyedTable(spark, made.path, SCHEMA)
    assert table(again.rows()) == table(made.rows()) == table(records.delete_entities(expected, gone))
    assert (again.version, again.buckets) == (made.version, made.buckets) == (3, 20)


def test_get_reads_the_buckets_of_its_keys(spark, stored):
    made, _ = stored
    found = made.get(spark.createDataFrame([("k5",)], "id string"))
    read = {row[0] for row in made.rows(made._touched(spark.createDataFrame([("k5",)], "id string"))).select(F.input_file_name()).distinct().collect()}
    assert table(found) == {("k5", "t5", 5)} and len(read) == 1


def test_a_failed_change_leaves_no_trace(spark, stored):
    made, start = stored
    with pytest.raises(PySparkException, match="no key"):
        made.upsert(spark.createDataFrame([(None, "x", 1)], SCHEMA))
    start.withColumn("_bucket", F.lit(3)).write.partitionBy("_bucket").parquet(made._folder("lost"))  # rows of a change that never came to its log
    assert table(KeyedTable(spark, made.path, SCHEMA).rows()) == table(start)


def test_buckets_may_become_empty(spark, stored):
    made, start = stored
    made.delete(start.select("id"))
    assert made.rows().count() == 0 and KeyedTable(spark, made.path, SCHEMA).rows().count() == 0
    assert made.upsert(start.limit(1)) and KeyedTable(spark, made.path, SCHEMA).rows().count() == 1
