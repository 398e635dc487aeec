"""The stored vector index: recall against exact search, files read, odd vectors."""

import math
import random

from pyspark.sql import functions as F

from riskloom.operators import vector_index as vix
from riskloom.operators import vectors
from riskloom.sources.star_schema import load_graph


def recall(index, chunks, asked, share=None):
    exact = vectors.search_many(chunks, dict(enumerate(asked)), 10).collect()
    found = 0
    for i, query in enumerate(asked):
        got = {r.id for r in vix.search(index, query, 10, share).collect()}
        assert len(got) == 10
        found += len(got & {x.chunk_id for x in exact if x.question_id == i})
    return found / 10 / len(asked)


def files(df):
    return len(set(df.inputFiles()))


def test_recall_and_files_read(spark, tmp_path):
    """Vectors in all directions alike, the hardest case: the share that is measured is large, and the recall is there."""
    chunks = load_graph(spark, "/root/testdata/sf0.1").chunks.select("id", "embedding").cache()
    index = vix.build(chunks, str(tmp_path / "index"))
    assert index.vectors.count() == chunks.count()
    assert index.vectors.filter("cell < 0").count() == chunks.filter("embedding is null").count()
    asked = [r.embedding for r in chunks.filter(F.col("id").isin("chk-7", *[f"chk-{i}" for i in range(100, 2000, 200)])).collect()]
    assert len(asked) > 5 and recall(index, chunks, asked) >= 0.9
    near = vix.cells_near(index, asked[0])
    plan = index.vectors.filter(F.col("cell").isin(near))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [cell" in plan
    assert len(index.vectors.filter(F.col("cell").isin(near)).select(F.input_file_name().alias("f")).distinct().collect()) < files(index.vectors)


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    pick = random.Random(1)
    centres = [[pick.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(f"v{i:05}", [x + pick.gauss(0, 0.1) for x in pick.choice(centres)]) for i in range(4000)]
    chunks = spark.createDataFrame(rows, "id string, embedding array<double>").cache()
    index = vix.build(chunks, str(tmp_path / "index"), cells=80)
    assert index.share < 0.12
    assert recall(index, chunks, [r[1] for r in rows[:8]]) >= 0.9


def test_odd_vectors(spark, tmp_path):
    odd = [("none", None), ("empty", []), ("short", [1.0]), ("zero", [0.0, 0.0]), ("nan", [math.nan, 1.0]), ("gap", [None, 1.0]), ("inf", [math.inf, 1.0])]
    rows = [(f"a{i:02}", [1.0, 0.0]) for i in range(30)] + [("b", [0.0, -2.0]), ("b", [0.0, -2.0])] + odd
    chunks = spark.createDataFrame([(*r, "x") for r in rows], "id string, embedding array<double>, cell string").drop("cell")
    index = vix.build(chunks, str(tmp_path / "index"), cells=3)
    assert {r.id for r in index.vectors.filter("cell < 0").collect()} == {i for i, _ in odd}
    assert [r.id for r in vix.search(index, [0.0, -1.0], 3).collect()] == ["b", "b", "a00"]
    assert vix.search(index, [1.0], 3).count() == vix.search(index, [0.0, 0.0], 3).count() == 0
    vix.add(spark, index.path, spark.createDataFrame([("new", [0.1, -5.0])], "id string, embedding array<double>"))
    again = vix.open_index(spark, index.path)
    assert again.rows.sum() == index.rows.sum() + 1
    assert "new" in {r.id for r in vix.search(again, [0.0, -1.0], 3).collect()}
    none = vix.build(chunks.limit(0), str(tmp_path / "none"))
    assert vix.search(none, [1.0], 3).count() == 0
