import math

import numpy as np

from riskloom.llm import quality
from tests.llm.conftest import SF


def test_risk_separates_without_negative_labels():
    rng = np.random.default_rng(4)
    n = quality.N_FEATURES
    good, bad = rng.normal(0, 1, (3000, n)), rng.normal(0, 1, (1000, n))
    bad[:, :3] += 4
    mixed = np.concatenate([good[1000:], bad[:700]])
    scorer = quality.fit(good[:1000], mixed, 2000 / 2700)
    assert (scorer(good[2000:]) >= 0.5).mean() > 0.95 and (scorer(bad[700:]) < 0.5).mean() > 0.95


def brute_scores(positive, unlabelled, prior, asked):
    """The same risk written down row by row, its slopes taken one weight at a time, minimised by the same steps."""
    n, bins = len(positive[0]), quality.BINS
    both = [*positive, *unlabelled]
    edges = [[float(np.quantile([r[j] for r in both], k / bins)) for k in range(1, bins)] for j in range(n)]
    hot = lambda row: [j * bins + sum(e <= v for e in edges[j]) for j, v in enumerate(row)]
    p, u, size = [hot(r) for r in positive], [hot(r) for r in unlabelled], n * bins
    w, bias = [0.0] * size, 0.0
    first, second = [0.0] * (size + 1), [0.0] * (size + 1)
    sigmoid = lambda g: 1 / (1 + math.exp(-g))
    score = lambda on: sigmoid(sum(w[i] for i in on) + bias)
    for step in range(1, quality.STEPS + 1):
        sp, su = [score(r) for r in p], [score(r) for r in u]
        negative = sum(su) / len(u) - prior * sum(sp) / len(p)
        rise = [0.0] * (size + 1)  # slope of the risk that this step lowers
        for weight, rows, scores in (((-2 * prior, p, sp), (1.0, u, su)) if negative >= 0 else ((prior, p, sp), (-1.0, u, su))):
            for on, s in zip(rows, scores):
                for i in (*on, size):
                    rise[i] += weight * s * (1 - s) / len(rows)
        for i in range(size):
            rise[i] += quality.DECAY * w[i]
        for i in range(size + 1):
            first[i] = 0.9 * first[i] + 0.1 * rise[i]
            second[i] = 0.999 * second[i] + 0.001 * rise[i] ** 2
            move = quality.RATE * (first[i] / (1 - 0.9 ** step)) / (math.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
            if i < size:
                w[i] -= move
            else:
                bias -= move
    return [score(hot(r)) for r in asked]


def test_fit_equals_a_plain_minimiser(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 60)
    monkeypatch.setattr(quality, "N_FEATURES", 3)
    rng = np.random.default_rng(2)
    positive, unlabelled, asked = (rng.normal(m, 1, (n, 3)) for m, n in ((0, 25), (1, 40), (0.5, 20)))
    for prior in (0.3, 0.9):  # the second makes the negative part fall below zero
        got = quality.fit(positive, unlabelled, prior)(asked)
        assert np.allclose(got, brute_scores(positive.tolist(), unlabelled.tolist(), prior, asked.tolist()), atol=1e-6)


def test_held_out_accuracy_and_independence_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in quality.op2_pu_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(rows[i].predicted, q) for i, q in labels.items() if i in rows and rows[i].held_out]
    assert len(held) > 80 and sum(p == q for p, q in held) / len(held) > 0.95
    assert all(r.held_out == quality.held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    turned = spark.createDataFrame([(i, 1 - q if quality.held_out(i) else q) for i, q in labels.items()], "doc_id long, quality int")
    again = {r.row.doc_id: r.score for r in quality.scored(docs, quality.learn(docs, turned)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in rows.items())


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 40_000), (4, "same"), (4, "same"), (5, "\x00é𝄞")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        got = quality.scored(docs, quality.learn(docs, given)).collect()
        assert sorted(str(r.row.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert got[0].row.asDict().keys() == set(docs.columns)
    assert quality.scored(docs_of([]), quality.learn(docs_of([]), labels)).count() == 0
    assert quality.stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).columns == ["doc_id", "text", "lang", "source", "n_chars"]
