import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import middle
from tests.llm.conftest import SF


@pytest.mark.parametrize("error", [1, 9, middle.ERROR])
def test_rank_index_is_exact_and_bounded(error):
    pick = np.random.default_rng(error)
    for steps in ([], [7], pick.integers(1, 12, 9000), pick.geometric(0.001, 6000), [1] * 5000 + [10 ** 9] + [3] * 5000):
        offsets = np.cumsum(np.array(steps, np.int64))
        index = middle.RankIndex(error)
        for at in range(0, len(offsets), 4000):
            index.extend(offsets[at:at + 4000])
        assert [index[k] for k in range(len(index))] == offsets.tolist()
        assert all(abs(index.predicted(k) - v) <= error + 1 for k, v in enumerate(offsets))
    assert len(index.ranks) < 10 if error == middle.ERROR else True


def test_boundaries_are_those_of_the_pattern():
    pick = random.Random(2)
    for chunk in (1, 3, 1000):
        for _ in range(100):
            text = "".join(pick.choices("abZ é,.\n中𝄞`[@{", k=pick.randrange(40)))
            index = middle.boundaries(text, chunk=chunk)
            ends = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text, re.S)]
            assert [index[k] for k in range(len(index))] == [0, *ends]


def brute(doc_id, text):
    text, seed = text or "", "" if doc_id is None else str(doc_id)
    h = hashlib.sha256(f"1:{seed}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    t = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h[3] % 100 < 20:
        return doc_id, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_rows(spark, docs_of):
    odd = [None, "", "a", " ", "<P> taken", "x<M>", "almost <P", "<<S", "é中𝄞\x00\n" * 9, "word, " * 40_000, "a" * 100_000]
    rows = [(i, t) for i in range(30) for t in ("one two three", "< P>", odd[i % len(odd)])] + [(None, "no id"), (7, "same"), (7, "same"), *enumerate(odd)]
    got = middle.transform(docs_of(rows)).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter(brute(*r) for r in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.transform(docs_of([])).count() == 0


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, middle.op11_fill_in_middle(spark, SF).collect())) == sorted(db.execute(middle.ORACLE).fetchall())
