import random
from collections import Counter

import pytest

from riskloom.llm import substrings
from tests.llm.conftest import SF

M = substrings.MATCH


def brute(rows):
    data = [((t or "").encode() if not isinstance(t, bytes) else t) for _, t in rows]
    key = [float("inf") if i is None else i for i, _ in rows]
    least = {}
    for k, d in zip(key, data):
        for p in range(len(d) - M + 1):
            w = d[p:p + M]
            least[w] = min(k, least.get(w, k))
    out = []
    for (doc, _), k, d in zip(rows, key, data):
        gone = bytearray(len(d))
        for p in range(len(d) - M + 1):
            if least[d[p:p + M]] < k:
                gone[p:p + M] = b"\1" * M
        out.append((doc, len(d), bytes(b for b, g in zip(d, gone) if not g)))
    return Counter(out)


def rows_of(df):
    got = df.collect()
    for r in got:
        assert all(a.start + a.length < b.start for a, b in zip(r.removed, r.removed[1:])) and sum(x.length for x in r.removed) + len(r.kept) == r.n_bytes
    return Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got)


def passages(seed):
    pick = random.Random(seed)
    text = lambda n: "".join(pick.choices("abcdefgh é", k=n))
    shared = [text(n) for n in (48, 49, 50, 51, 60, 80, 300, 26, 40)]
    rows = [(None, None), (7, ""), (8, "short"), (9, "a" * 400), (10, "a" * 60 + "b"), (11, "ab" * 500), (11, "ab" * 500), (12, "ba" * 40)]
    for i in range(60):
        parts = [text(pick.randrange(0, 40))]
        for _ in range(pick.randrange(1, 5)):
            s = pick.choice(shared)
            cut = pick.randrange(0, 20)
            parts += [s if pick.random() < 0.6 else s[cut:] if pick.random() < 0.5 else s[:len(s) - cut], text(pick.randrange(0, 12))]
        rows.append((pick.choice([i + 20, i + 20, 500 - i, 30, None]), "".join(parts)))
    rows += [(3, rows[20][1]), (900, rows[20][1]), (901, rows[20][1])]
    return rows


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_odd_rows(spark, docs_of, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 1500)
    rows = passages(crowd)
    assert rows_of(substrings.deduplicate(docs_of(rows))) == brute(rows)


def test_empty_table(spark, docs_of):
    assert substrings.deduplicate(docs_of([])).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(substrings.deduplicate(spark.read.parquet(f"{SF}/documents.parquet"))) == brute(rows)
    found = substrings.op1_suffix_dedup(spark, SF).collect()
    assert len(found) == len(rows) and any(r.n_spans for r in found) and not all(r.n_spans for r in found)
