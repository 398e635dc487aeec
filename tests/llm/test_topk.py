import math
from collections import Counter

import duckdb

from riskloom.llm import topk
from tests.llm.conftest import SF


def brute(rows, k):
    vs = [(n, i, [math.floor(64 * float(x)) for x in v]) for n, (i, v) in enumerate(rows)
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in vs:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in vs if m != n and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return Counter(out)


def test_odd_rows(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [9.0, 9.0]), (20, [1.0, 2.0]),
            (20, [1.0, 2.0]), (40, [1.0, 2.0, 3.0]), (7, [-0.01, 0.5]), (60, [1e7, -1e7]), (8, [2e7, 1e-3])] + [(100 + i, [0.5, 0.5]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")
    for size in (4096, 7):
        monkeypatch.setattr(topk, "SHARD_ROWS", size)
        monkeypatch.setattr(topk, "QUERY_ROWS", size)
        monkeypatch.setattr(topk, "FAN_IN", 2)
        assert Counter(map(tuple, topk.search(df, 5).collect())) == brute(rows, 5)
    assert topk.search(df.limit(0)).count() == 0


def test_components_near_the_end_of_the_doubles(spark):
    """Products beyond 64 bits count as the nearest that fits; sums that fit are exact, however large their terms."""
    rows = [(0, [1e308, 1.0]), (20, [1.0, 0.0]), (1, [1e308, 1e308]), (2, [-1.7e308, 0.0]), (3, [0.5, 7.0]), (4, [2.0 ** 1000, -(2.0 ** 1000)]), (40, [2.0 ** 900, 2.0 ** 900])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = Counter()
    exact = [(i, [int(x) * 64 if abs(x) >= 2.0 ** 53 else math.floor(64 * x) for x in v]) for i, v in rows]
    for i, q in exact:
        if i % 20 == 0:
            clipped = sorted((-max(-(2 ** 63) + 1, min(2 ** 63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in exact if j != i)[:5]
            held.update((i, r, j, -s) for r, (s, j) in enumerate(clipped, 1))
    assert Counter(map(tuple, topk.search(df, 5).collect())) == held
    assert held[(40, 5, 4, 0)] or any(k[0] == 40 and k[2:] == (4, 0) for k in held)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op4_exact_topk(spark, SF).collect())) == sorted(db.execute(topk.ORACLE).fetchall())


def test_many_equal_scores_and_lists_merged_in_a_task(spark, monkeypatch):
    rows = [(i % 90, [float(i % 3), 1.0] if i % 7 else [1e7, float(i)]) for i in range(400)] + [(i, [0.5, 0.25, float(i % 2)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    found = topk.search(df, 5)
    assert Counter(map(tuple, found.collect())) == brute(rows, 5)
    # Shards and blocks meet where they are read: nothing but the lists is dealt out.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "cells" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
