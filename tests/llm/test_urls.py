import random
from collections import Counter

import duckdb
import pytest

from riskloom.llm import urls
from tests.llm.conftest import SF


def parse(url):
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    path = rest[cut:]
    path = path[:min([k for k in map(path.find, "?#") if k >= 0], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def brute(url, rules, default="allow"):
    """Every rule is tried on every URL."""
    host, path = parse(url)
    fit = [r for r in map(urls.Rule.of, rules) if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host.split(".")) if r.host else 0, len(r.path), r.verdict == "block"), default=None)
    return (host, path, None, default) if best is None else (host, path, best.host + best.path, best.verdict)


ODD = [None, "", "no mark", "http://", "://x.org/", "http://ORG/", "http://Ünï.ORG/É?x", "http://example.org", "http://example.org?/es/", "http://notexample.org/es/",
       "http://a.example.org/es/x", "http://example.org/es", "http://example.org/en/17/x#y", "http://example.org/en/2", "http://a.com/fr/../de/", "http://b.com/de/",
       "http://.org/", "http://org./", "http://u@example.org:80/es/", "http://e.org/a://b.com/de/", "http://x.org\n/\n?", "http://example.org/" + "a/" * 20_000, "ftp://net/"]


@pytest.mark.parametrize("max_bytes", [urls.MAX_RULE_BYTES, 20])
def test_odd_urls(spark, max_bytes):
    rows = [*enumerate(ODD), (5, ODD[5]), (5, ODD[5]), (None, ODD[10])]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in rows], "page_id long, url string, host string, row string, best int")
    for rules in (urls.RULES, [], ["block /", "allow org", "block org", "allow example.org/en/", "block A.example.org/es/", "allow example.org/es/x/y/z", "allow com/fr/../"]):
        got = urls.judged(pages, rules, max_bytes=max_bytes).collect()
        assert Counter((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *brute(u, rules)) for i, u in rows)
        assert all(r.row.host == "h" and r.row.best == 1 for r in got)
        kept = urls.allowed(pages, rules)
        assert kept.columns == pages.columns
        assert kept.count() == sum(brute(u, rules)[3] == "allow" for _, u in rows)
    assert urls.judged(pages.limit(0), urls.RULES).count() == 0


def test_trie_equals_brute_force():
    pick = random.Random(4)
    place = lambda: ".".join(pick.choices("ab", k=pick.randrange(4))) + pick.choice(["", "/" + "".join(pick.choices("ab/", k=pick.randrange(5)))])
    for _ in range(200):
        rules = [f"{pick.choice(['allow', 'block'])} {place() or 'a'}" for _ in range(pick.randrange(12))]
        trie = urls.UrlTrie(map(urls.Rule.of, rules))
        for _ in range(30):
            url = "x://" + place()
            best = trie.longest(*parse(url))
            assert (*parse(url), best and best.host + best.path, best.verdict if best else "allow") == brute(url, rules)


def test_rules_are_cut_by_bytes():
    lines = [f"block h{i}.org/p" for i in range(100)]
    cut = list(urls.parts(lines, 50))
    assert sum(cut, []) == list(map(urls.Rule.of, lines)) and len(cut) > 10
    assert all(sum(len(r.host + r.path) for r in p) <= 50 for p in cut) and list(urls.parts([])) == [[]]
    with pytest.raises(ValueError):
        urls.Rule.of("maybe x.org/")


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = sorted(map(tuple, urls.op13_url_filter(spark, SF).collect()), key=str)
    assert got == sorted(db.execute(urls.ORACLE).fetchall(), key=str)
    assert {r[4] for r in got} == {"allow", "block"} and any(r[3] is None for r in got)
