import random
from collections import Counter

import numpy as np

from riskloom.llm import lines
from tests.llm.conftest import SF


def brute(rows):
    """Rows (doc_id, text) in input order to (doc_id, text after removal)."""
    keys = sorted({x.strip() for _, t in rows for x in (t or "").split("\n") if x.strip()})
    sets = [lines.shingles(k) for k in keys]
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    at = {k: find(i) for i, k in enumerate(keys)}
    seen, out = set(), {}
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n)):
        kept = []
        for x in (rows[n][1] or "").split("\n"):
            if x.strip():
                if at[x.strip()] in seen:
                    continue
                seen.add(at[x.strip()])
            kept.append(x)
        out[n] = None if rows[n][1] is None else "\n".join(kept)
    return Counter((rows[n][0], t) for n, t in out.items())


def edited(words, pick):
    words = list(words)
    words[pick.randrange(len(words))] = "".join(pick.choices("abcdefgh", k=6))
    return " ".join(words)


def test_odd_rows_and_large_groups(spark, docs_of, monkeypatch):
    pick = random.Random(9)
    base = ["".join(pick.choices("abcdefghijklmnop", k=7)) for _ in range(60)]
    rows = [(5, None), (6, ""), (7, "\n\n x \n"), (8, "x"), (None, "only null\nx"), (None, "only null"), (9, "same\nsame\n\nsame "), (9, "same"), (10, "é" * 40_000), (11, "é" * 40_000 + "a")]
    rows += [(100 + i, f"line {i} of its own {pick.random()}\n" + edited(base, pick)) for i in range(40)]
    rows += [(200 + i, edited(base[:30], pick)) for i in range(4)]
    want = brute(rows)
    for paired in (6, 2):
        monkeypatch.setattr(lines, "PAIRED", paired)
        got = lines.deduplicate(docs_of(rows)).select("row.doc_id", "text").collect()
        assert Counter(map(tuple, got)) == want
    assert lines.deduplicate(docs_of([])).count() == 0


def test_members_that_fail_the_first_of_a_large_group_are_still_linked(spark, docs_of, monkeypatch):
    """A chain: neighbours are similar, its ends are not, and all share every band."""
    monkeypatch.setattr(lines, "PAIRED", 2)
    monkeypatch.setattr(lines, "LEADS", 1)
    monkeypatch.setattr(lines, "TILE_LINES", 3)
    monkeypatch.setattr(lines, "band_hashes", lambda rows: np.full((len(rows), lines.BANDS), 7, np.uint64))
    words = [f"word{i:03d}" for i in range(100)]
    rows = [(i, " ".join(words[i * 5:i * 5 + 60])) for i in range(8)] + [(20, "something else altogether, which stays")]
    got = Counter(map(tuple, lines.deduplicate(docs_of(rows)).select("row.doc_id", "text").collect()))
    assert got == brute(rows)


def test_signatures_estimate_similarity():
    pick = random.Random(1)
    a = " ".join("".join(pick.choices("abcdefghij", k=6)) for _ in range(50))
    b = a[:150] + "other words" + a[161:]
    x, y = lines.shingles(a), lines.shingles(b)
    rows = lines.signatures([a, b, "ab", "ab ", "abc", a])
    assert abs((rows[0] == rows[1]).mean() - len(x & y) / len(x | y)) < 0.2
    assert (rows[2] == rows[3]).all() and not (rows[2] == rows[4]).any() and (rows[0] == rows[5]).all()


def test_sets_of_numbers_compare_like_sets_of_shingles():
    assert lines.SHINGLE == 6 and lines.shingles(" abcdefgh ") == {"abcdef", "bcdefg", "cdefgh"}
    pick = random.Random(3)
    for n in (1, 2, 3, 40):
        texts = ["".join(pick.choices("ab é", k=pick.choice([0, 1, 5, 6, 7, 40, 300]))) for _ in range(n)]
        texts += [t[:-1] + "b" for t in texts] + [t * 2 for t in texts]
        numbers, ends = lines.shingle_sets(texts)
        sets = [lines.shingles(t) for t in texts]
        assert np.diff(np.r_[0, ends]).tolist() == [len(x) for x in sets] and len(numbers) == ends[-1]
        x, y = (np.array([pick.randrange(len(texts)) for _ in range(500)]) for _ in range(2))
        want = [len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in zip(x, y)]
        assert lines.similar(texts, x, y).tolist() == want and any(want)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = lines.deduplicate(spark.read.parquet(f"{SF}/documents.parquet"))
    assert Counter(map(tuple, out.select("row.doc_id", "text").collect())) == brute(rows)
    found = lines.op3_line_dedup(spark, SF).collect()
    assert len(found) == len(rows) and sum(r.n_removed for r in found) > 0
