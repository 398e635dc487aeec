import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import runs
from tests.llm.conftest import SF


def brute(words):
    """Runs by comparing every word with the one q places on, for every q."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def random_text(pick):
    letters = pick.choice([1, 2, 3, 30])
    words = [pick.randrange(letters) for _ in range(pick.choice([0, 1, 5, 6, 7, 40, 150]))]
    if pick.random() < 0.5 and words:
        a = pick.randrange(len(words))
        p = 1 + (len(words) - a) // pick.randrange(3, 11)
        words[a:] = [words[a + i % p] for i in range(len(words) - a)]
    return words


@pytest.mark.parametrize("together", [1, 5])
def test_runs_equal_brute_force(together):
    pick = random.Random(together)
    for _ in range(150):
        texts = [random_text(pick) for _ in range(together)]
        text, *rest = runs.find(np.array(sum(texts, []), np.int64), np.cumsum([len(t) for t in texts]))
        got = [[tuple(map(int, r)) for k, *r in zip(text, *rest) if k == t] for t in range(together)]
        assert got == [[(s, n, q) for s, n, q in brute(t)] for t in texts]


def test_texts_beyond_the_kept_grid(monkeypatch):
    monkeypatch.setattr(runs, "GRID_WORDS", 64)
    monkeypatch.setattr(runs, "GRID_POINTS", 50)
    monkeypatch.setattr(runs, "_grids", runs._Grids())
    pick = random.Random(3)
    for _ in range(60):
        words = random_text(pick)
        assert [tuple(map(int, r[1:])) for r in zip(*runs.find(np.array(words, np.int64), np.array([len(words)])))] == brute(words)


@pytest.mark.parametrize("letters", [1, 2, 9])
def test_grammar_extents(letters):
    pick = random.Random(letters)
    words = [pick.randrange(letters) for _ in range(500)]
    grammar = runs.Grammar(np.array([0, *(w + 2 for w in words), 1]), 2)
    assert len(grammar.top) == 3 and len(grammar.levels) < 40
    pairs = [sorted(pick.sample(range(500), 2)) for _ in range(400)]
    i, j = (np.array(x, np.int32) + 1 for x in zip(*pairs))
    for (a, b), right, left in zip(pairs, grammar.extent(i, j, 1), grammar.extent(i, j, -1)):
        assert right == next((k for k in range(500 - b) if words[a + k] != words[b + k]), 500 - b)
        assert left == next((k for k in range(a + 1) if words[a - k] != words[b - k]), a + 1)


ODD = [None, "", " \n\t\x0b\x0c\r ", "a", "na " * 6, " na" * 5, "x\x1cy\u00a0z " * 9, "é " * 20_000, "a b c d " * 4 + "tail", "a a a a a a b a a a a a a b " * 5,
       "lead " + "one two " * 7 + "one three"]


def test_odd_rows(spark, docs_of):
    rows = [*enumerate(ODD), (3, ODD[4]), (3, ODD[4]), (None, ODD[8])]
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(docs_of(rows)).collect())
    found = lambda t: brute(split(t)) if t is None or len(t) < 30_000 else [(0, 20_000, 1)]
    assert got == Counter((i, len(split(t)), tuple(found(t)), collapsed(split(t), found(t))) for i, t in rows)
    assert runs.periodic_runs(docs_of([])).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in runs.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words, h = split(d.text), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want = (d.doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hexed("".join(f"{s},{n},{q}\n" for s, n, q in found)), hexed(collapsed(words, found)))
        assert tuple(got[d.doc_id]) == want
    assert any(r.n_runs for r in got.values()) and not all(r.n_runs for r in got.values())
