import random

import numpy as np
import pyarrow as pa

from riskloom.llm import lines, neardocs
from tests.llm.test_simhash import components_of


def brute_groups(rows):
    sets = [set(zip(*(w[i:] for i in range(5)))) if len(w := (t or "").lower().split()) >= 5 else {tuple(w)} for _, t in rows]
    edges = [(x, y) for x in range(len(rows)) for y in range(x) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    root = components_of(range(len(rows)), edges)
    return {min((rows[i][0] is None, rows[i][0] or 0) for i in root if root[i] == r) for r in set(root.values())}


def test_edited_copies_are_one_group(spark, docs_of, monkeypatch):
    pick = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (None, " \t"), (3, "A b"), (4, "a B"), (5, "a b c")]
    for group in range(12):
        base = pick.choices(words, k=300)
        for _ in range(3):
            text = list(base)
            for at in pick.sample(range(300), 3):
                text[at] = "new"
            rows.append((len(rows) + 10, " ".join(text)))
    chain = pick.choices(words, k=200)
    for at in range(60):  # each like the next, the ends unlike
        chain[3 * at] = f"step{at}"
        rows.append((len(rows) + 10, " ".join(chain)))
    rows += [(1000 + i, " ".join(pick.choices(words, k=80))) for i in range(20)]
    want = brute_groups(rows)
    assert len(want) < len(rows) - 80
    for most, tile in ((lines.PAIRED, neardocs.TILE_DOCS), (2, 7)):
        monkeypatch.setattr(lines, "PAIRED", most)
        monkeypatch.setattr(neardocs, "TILE_DOCS", tile)
        kept = neardocs.deduplicated(docs_of(rows))
        assert kept.columns == docs_of(rows).columns
        got = [(r.doc_id is None, r.doc_id or 0) for r in kept.collect()]
        assert len(got) == len(want) and set(got) == want


def test_fingerprints_are_simhashes_of_the_sets():
    for size in (1, 2, 3, 4, 255, 256, 700):
        hashes = np.unique(np.random.default_rng(size).integers(0, 1 << 64, size, np.uint64))
        bits = lambda x: np.unpackbits(lines._mix(x ^ neardocs._SALTS).view(np.uint8), bitorder="little").astype(int)
        tie = bits(hashes[0] if size < 4 else np.uint64(0))
        want = 2 * sum(bits(h) for h in hashes) + tie > size
        got = neardocs.fingerprint(hashes.view(np.int64))
        assert len(got) * 64 == neardocs.BITS and np.array_equal(np.unpackbits(got.view(np.uint8), bitorder="little"), want)


def test_similar_sets_share_a_band_and_check_bits():
    draw = np.random.default_rng(3)
    limit = neardocs.check_limit(0.8)
    for n_sets in (2, 50_000, 10_000_000):
        bands, missed = neardocs.band_bits(n_sets, 0.8), 0
        assert bands.min() >= neardocs.CHECK and all(len(set(b)) == len(b) for b in bands.tolist())
        assert n_sets / 2 ** bands.shape[1] <= neardocs.GROUP
        for same, more in ((8, 2), (80, 20), (240, 60)):
            for _ in range(200):
                both = draw.integers(0, 1 << 64, same + more, np.uint64)
                one, other = (neardocs.fingerprint(np.sort(x).view(np.int64)) for x in (both[:same], both))
                unlike = np.unpackbits((one ^ other).view(np.uint8), bitorder="little")
                missed += unlike[bands].any(1).all() or unlike[:neardocs.CHECK].sum() > limit
        assert missed <= 4


def test_candidates_of_groups_of_any_size():
    """Close fingerprints meet, however large the group: as pairs, or as members of one crowd."""
    draw, limit = np.random.default_rng(8), 12
    check = draw.integers(0, 1 << 64, (900, 2), np.uint64)
    check[100:500] = check[100]  # 400 of one kind, a bit apart; two more pairs; the others alone
    check[np.arange(100, 500), 0] ^= np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64)
    check[1], check[7] = check[0], check[600]
    check[300:320] = check[300] ^ np.uint64(0xFFFF)  # near none of that kind, near each other
    for groups in ([900], [700, 200], [50] * 18):
        packed = np.zeros(900, neardocs._ENTRY)
        packed["rest"], packed["key"], packed["check"] = np.repeat(np.arange(len(groups)), groups), np.arange(900) * 7 - 2000, check
        found = neardocs._candidates(pa.table({"bucket": [3], "entries": [draw.permutation(packed).tobytes()]}), limit).to_pylist()
        crowds = {}
        for r in found:
            if r["crowd"] >= 0:
                crowds.setdefault(r["crowd"], set()).add(r["a"])
        met = {frozenset((r["a"], r["b"])) for r in found if r["a"] != r["b"]} | {frozenset((x, y)) for c in crowds.values() for x in c for y in c if x != y}
        differ = np.bitwise_count(check[:, None] ^ check).sum(-1)
        near = (differ <= limit) & (packed["rest"][:, None] == packed["rest"])
        want = {frozenset((int(packed["key"][i]), int(packed["key"][j]))) for i, j in np.argwhere(near) if i != j}
        assert want <= met
        alone = set(packed["key"][near.sum(1) == 1].tolist())
        assert not alone & {k for r in found for k in (r["a"], r["b"])} and len(found) < 30 * len(packed)


def test_a_large_group_of_copies_with_outsiders(spark, docs_of):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    base = pick.choices(words, k=120)
    rows = []
    for i in range(350):
        text = list(base)
        for at in pick.sample(range(120), 1 + i % 4):
            text[at] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(pick.choices(words, k=40))) for i in range(60)]
    want = brute_groups(rows)
    got = [(False, r.doc_id) for r in neardocs.deduplicated(docs_of(rows)).collect()]
    assert len(got) == len(want) and set(got) == want
