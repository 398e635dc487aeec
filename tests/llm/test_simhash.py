import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from riskloom.llm import common, simhash
from tests.llm.conftest import SF


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    distinct = {}
    for i, p in enumerate(prints):
        root[i] = find(distinct.setdefault(p, i))
    keys = list(distinct)
    for x in range(len(keys)):
        for y in range(x):
            if (keys[x] ^ keys[y]).bit_count() <= 2:
                root[find(distinct[keys[x]])] = find(distinct[keys[y]])
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows))


def answer(df):
    return Counter(map(tuple, df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()))


def test_odd_rows(spark, docs_of):
    words = [f"w{i}" for i in range(400)]
    rows = [(9, None), (3, ""), (None, " \t "), (4, "A b"), (5, "a B"), (6, "a"), (7, "x " * 60_000), (8, "x " * 60_000), (8, "x " * 60_000), (None, None), (10, "a b c d")]
    rows += [(100 + i, " ".join(words[:i] + ["new"] + words[i + 1:])) for i in range(40)]
    docs = docs_of(rows)
    assert answer(simhash.component_ids(docs)) == brute_components(rows)
    assert simhash.component_ids(docs_of([])).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    groups = {c for _, _, c in brute_components(rows)}
    assert set(ids) - {None} == groups - {None} and max(ids.values()) == 1


def test_links_of_small_and_crowded_buckets_equal_brute_force(spark, monkeypatch):
    pick = random.Random(8)
    centre = [pick.getrandbits(64) for _ in range(6)]
    prints = {simhash._signed(c ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(4)))) for c in centre for _ in range(60)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = components_of(prints, near)
    for most in (1000, 3, 1):
        monkeypatch.setattr(simhash, "COMPARED", most)
        found = [tuple(r) for r in simhash.links(df).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
        assert components_of(prints, found) == want
    monkeypatch.setattr(simhash, "COMPARED", 1000)
    assert {tuple(sorted(r)) for r in simhash.links(df).collect()} == set(near)


def components_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(pick.randrange(100, 400), pick.randrange(100, 400)) for _ in range(220)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == components_of(nodes, [e for e in edges if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = simhash.op6_simhash_components(spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_components(rows)
