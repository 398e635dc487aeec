"""Expansion over a stored adjacency."""

from collections import Counter

from conftest import _edges
from pyspark.sql import functions as F

from riskloom import AuditGraph
from riskloom.operators import adjacency as adj
from riskloom.operators import patterns as pt


def graphs(spark):
    rows = [f"d1 IDENTIFIES fm{i}" for i in range(60)] + [f"fm{i} IMPLIES r{i % 7}" for i in range(60)] + ["c1 MITIGATES r3", "s1 IMPLEMENTS c1", "p1 SUPERSEDES p1"]
    return [AuditGraph(spark, {}, _edges(spark, rows), extractions=None, chunks=None) for _ in range(2)]


def test_expansion_equals_the_join_with_all_edges(spark, tmp_path):
    plain, stored = graphs(spark)
    stored.adjacency = adj.store(stored, str(tmp_path / "adjacency"), buckets=3, slice_edges=9)
    hubs = {r.id: r.slices for r in stored.adjacency.hubs.collect()}
    assert hubs["d1"] == 7 and "c1" not in hubs
    spread = stored.adjacency.hops().filter("id = 'd1'").select("slice").distinct().count()
    assert spread == 7
    seeds = spark.createDataFrame([("d1",), ("r3",), ("p1",), ("none",), ("d1",)], "id string")
    for types, direction in (((), "both"), (("IMPLIES",), "in"), (("IDENTIFIES", "MITIGATES"), "out")):
        want, got = (Counter(map(tuple, pt.expand_relationships(g, seeds, types, direction).collect())) for g in (plain, stored))
        assert got == want and want
    for depth in (0, 2, 5):
        want, got = (Counter(map(tuple, pt.reachable(g, seeds, depth).collect())) for g in (plain, stored))
        assert got == want
    stored.adjacency.drop()


def test_pages_by_key_are_those_by_offset(spark, tmp_path):
    rows = spark.range(107).select(F.format_string("k%05d", F.col("id") * 7 % 1000).alias("key"), F.col("id").alias("value")).union(
        spark.createDataFrame([(None, 9)], "key string, value bigint"))
    ids = sorted(r.key for r in rows.collect() if r.key)
    index = pt.page_index(rows, "key", 10)
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for number in range(12):
        assert [r.key for r in pt.page_by_key(rows, index, "key", number).collect()] == ids[10 * number:10 * number + 10]
    rows.repartitionByRange(8, "key").write.parquet(str(tmp_path / "rows"))
    plan = pt.page_by_key(spark.read.parquet(str(tmp_path / "rows")), index, "key", 5)._jdf.queryExecution().toString()
    assert f"GreaterThanOrEqual(key,{ids[50]}), LessThan(key,{ids[60]})" in plan


def test_a_hop_shuffles_no_edges(spark, tmp_path):
    _, stored = graphs(spark)
    stored.adjacency = adj.store(stored, str(tmp_path / "adjacency"), buckets=3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seeds = spark.range(100).select(F.concat(F.lit("fm"), "id").alias("id"))
        plan = pt.expand_relationships(stored, seeds, ("IMPLIES",))._jdf.queryExecution().sparkPlan().toString()
        executed = pt.expand_relationships(stored, seeds, ("IMPLIES",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "rel_type" in plan
    lines = executed.split("\n")
    scan = next(i for i, x in enumerate(lines) if "adjacency_" in x and "FileScan" in x)
    assert "Bucketed: true" in lines[scan] and "PartitionFilters: [isnotnull(rel_type" in lines[scan]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    level, above = depth(lines[scan]), []
    for x in reversed(lines[:scan]):  # from the scan up to the join
        if depth(x) < level:
            level = depth(x)
            above.append(x)
            if "Join" in x:
                break
    assert "Join" in above[-1] and not any("Exchange" in x for x in above)
    stored.adjacency.drop()
