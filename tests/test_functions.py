from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.dates import day_component
from riskloom.functions.ordering import with_previous, with_running_sums
from riskloom.functions.rounding import round_half_up
from riskloom.functions.text import locate_lines
from riskloom.operators.crossdoc import standard_code


def test_day_component_month_ends(spark):
    cases = [
        (datetime(2024, 1, 1), datetime(2024, 1, 31), 30), (datetime(2024, 1, 31), datetime(2024, 2, 29), 29),
        (datetime(2024, 1, 15), datetime(2024, 3, 20), 5), (datetime(2024, 1, 15, 12), datetime(2024, 2, 15, 11), 30),
        (datetime(2024, 1, 15, 12), datetime(2024, 1, 16, 11), 0),
    ]
    df = spark.createDataFrame(cases, "a timestamp_ntz, b timestamp_ntz, want int")
    assert [r.got for r in df.select(day_component(F.col("a"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]


def test_rounding_and_codes(spark):
    assert spark.range(1).select(round_half_up(F.lit(0.125), 2)).first()[0] == 0.13
    names = spark.createDataFrame([("a ST 7.pdf",), ("st0012",), ("ST 12345",), ("plain",)], "n string")
    assert [r[0] for r in names.select(standard_code(F.col("n"))).collect()] == ["ST007", "ST012", "ST12345", None]


def test_ordering_helpers_match_plain_windows(spark):
    # One key holds most rows, so it spans several range blocks.
    rows = spark.range(4000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    w = Window.partitionBy("k").orderBy("o")
    want = rows.select("k", "o", F.lag("v").over(w).alias("prev_v"), F.sum("v").over(w).alias("sum_v"))
    lagged = with_previous(rows, ["k"], ["o"], ["v"]).select("k", "o", "prev_v")
    summed = with_running_sums(rows, ["k"], ["o"], ["v"]).select("k", "o", "sum_v")
    assert lagged.exceptAll(want.select("k", "o", "prev_v")).isEmpty() and lagged.count() == 4000
    assert summed.exceptAll(want.select("k", "o", "sum_v")).isEmpty() and summed.count() == 4000


def test_locate_lines(spark):
    df = spark.createDataFrame([("a\nbb\ncc\ndd", "bb\ncc"), ("a", "z")], "t string, p string")
    got = [r[0] for r in df.select(locate_lines(F.col("t"), F.col("p"))).collect()]
    assert (got[0].line_start, got[0].line_end, got[1]) == (2, 3, None)


def test_csv_cells_equal_the_lookahead_definition(spark):
    import random
    import re
    from pyspark.sql import functions as F
    from riskloom.sources.files import csv_cells
    pick = random.Random(3)
    lines = ["", ",", '"a,b",c', 'a "b" ,"c,', '"' * 5 + ","] + ["".join(pick.choices('ab,," ', k=pick.randrange(20))) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", csv_cells(F.col("line")).alias("cells")).collect()
    for r in rows:
        assert r.cells == [c.replace('"', "").strip(" ") for c in re.split(r',(?=(?:[^"]*"[^"]*")*[^"]*$)', r.line)], r.line
