"""Range joins by bins, retrieval by shared words, and paths without dead ends."""

import random

from conftest import _edges, table
from pyspark.sql import functions as F

from riskloom import AuditGraph
from riskloom.functions.intervals import overlapping
from riskloom.operators import evaluate as ev
from riskloom.operators import patterns as pt


def test_overlaps_equal_brute_force(spark):
    pick = random.Random(1)
    ranges = lambda n: [(i, pick.choice("xy"), a := pick.randrange(-20, 60), a + pick.randrange(-2, 25)) for i in range(n)]
    left, right = ranges(80), ranges(80)
    want = {(i, j) for i, k, a, b in left for j, m, c, d in right if k == m and a <= b and c <= d and a <= d and c <= b}
    one = spark.createDataFrame([*left, (900, "x", None, 5)], "i int, k string, a int, b int")
    other = spark.createDataFrame([*right, (901, "x", 1, None), (902, None, 1, 9)], "j int, k string, c int, d int")
    for width in (1, 7, 1000):
        rows = overlapping(one, other, ["k"], ("a", "b"), ("c", "d"), width).select("i", "j").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_a_document_of_many_lines(spark):
    """A hundred thousand chunks and two thousand questions of one document: the join writes about a row per bin and match."""
    chunks = spark.range(100_000).select(F.lit("d").alias("document_id"), F.col("id").alias("chunk_id"), (F.col("id") + 1).alias("line_start"), (F.col("id") + 1).alias("line_end"))
    questions = spark.range(2_000).select(F.col("id").alias("question_id"), F.lit("d").alias("document_id"),
                                          (F.col("id") * 50 + 1).alias("source_line_start"), (F.col("id") * 50 + 3).alias("source_line_end"))
    got = ev.relevant_chunks(chunks, questions)
    assert got.count() == 6_000 and got.filter("chunk_id not between question_id * 50 and question_id * 50 + 2").count() == 0


def test_retrieval_reads_all_lines(spark):
    lines = [("d", i, f"filler{i} words here") for i in range(500)] + [("d", 500, "the NEEDLE stands here"), ("d", 501, "needle"), ("e", 0, "needle stands")]
    chunks = spark.createDataFrame(lines, "document_id string, chunk_id int, text string")
    questions = spark.createDataFrame([(1, "d", ["Needle stands.", "needle stands"]), (2, "d", []), (3, "none", ["needle"])], "question_id int, document_id string, expected_facts array<string>")
    rows = ev.retrieve_by_words(chunks, questions, 5).select("question_id", "rank", "chunk_id").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 500), (1, 2, 501)]


def test_paths_leave_out_dead_ends(spark):
    rows = ["f1 REFERENCES c1", "f2 REFERENCES c1", "c1 MITIGATES r1"] + [f"f{i} REFERENCES c9" for i in range(3, 40)]
    graph = AuditGraph(spark, {}, _edges(spark, rows), extractions=None, chunks=None)
    path = (("Finding", "REFERENCES", "Control"), ("Control", "MITIGATES", "Risk"))
    first, second = pt.path_steps(graph, path)
    assert table(first) == {("f1", "c1"), ("f2", "c1")} and table(second) == {("c1", "r1")}
    assert table(pt.match_path(graph, path)) == {("f1", "r1"), ("f2", "r1")}
    assert table(pt.match_path(graph, path[:1])) == {(r.split()[0], r.split()[2]) for r in rows if "REFERENCES" in r}
