"""URL filters by longest match in a trie.

The trie goes down the labels of a host from the last to the first, then down the segments of the path. A rule, allow or
block, sits at the node of its host and path; a URL takes the verdict of the deepest rule on its way.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import staged, table

#: Bytes of rules that one broadcast trie may hold; longer lists go in several passes.
MAX_RULE_BYTES = 32 << 20
#: Verdict of a URL that no rule fits.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MATCH = "struct<labels:int,chars:int,blocks:boolean,rule:string>"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, line: str) -> Rule:
        """From ``allow example.org/news/``; without a slash the path is empty and every path fits."""
        verdict, place = line.split(maxsplit=1)
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {line!r}")
        host, slash, path = place.strip().partition("/")
        return cls(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


class _Node:
    """Children by label or segment; ``rules`` by the last, perhaps unfinished, segment of a path."""

    __slots__ = ("labels", "segments", "rules", "lengths")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.rules: dict[str, Rule] = {}
        self.lengths: list[int] = []


def _labels(host: str) -> list[str]:
    return host.split(".")[::-1] if host else []


class UrlTrie:
    """Rules by reversed host labels, then path segments.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of the rules that fit, the one with
    most host labels wins, then the longest path; of an allow and a block entry for the same place the block wins.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in _labels(rule.host):
                node = node.labels.setdefault(label, _Node())
            *whole, open_end = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            if open_end not in node.rules or rule.verdict == "block":
                node.rules[open_end] = rule
                node.lengths = sorted({*node.lengths, len(open_end)}, reverse=True)

    def longest(self, host: str, path: str) -> Rule | None:
        hosts = [self.root]
        for label in _labels(host):
            node = hosts[-1].labels.get(label)
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in reversed(hosts):
            best = None
            for segment in segments:
                for n in node.lengths:
                    if n <= len(segment) and segment[:n] in node.rules:
                        best = node.rules[segment[:n]]
                        break
                node = node.segments.get(segment)
                if node is None:
                    break
            if best is not None:
                return best
        return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (between the first ``://`` and the next ``/ ? #``, A-Z lower-cased) and path (then up to ``? #``), else empty."""
    part = lambda k: F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def parts(rules: Iterable[str | Rule], max_bytes: int = MAX_RULE_BYTES) -> Iterator[list[Rule]]:
    """The rules in lists of at most ``max_bytes``, so that each list can be broadcast; one empty list if there are none."""
    part, size, empty = [], 0, True
    for rule in (r if isinstance(r, Rule) else Rule.of(r) for r in rules):
        n = len(rule.host.encode()) + len(rule.path.encode())
        if part and size + n > max_bytes:
            yield part
            part, size, empty = [], 0, False
        part.append(rule)
        size += n
    if part or empty:
        yield part


_tries: dict[str, UrlTrie] = {}


def _trie(rules: bytes) -> UrlTrie:
    """A worker keeps the trie of one list of rules."""
    key = hashlib.sha256(rules).hexdigest()
    if key not in _tries:
        _tries.clear()
        _tries[key] = UrlTrie(pickle.loads(rules))
    return _tries[key]


def _matcher(spark, rules: list[Rule]):
    shared = spark.sparkContext.broadcast(pickle.dumps(rules))

    @F.arrow_udf(MATCH)
    def match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = _trie(shared.value)
        for hosts, paths in batches:
            found = (trie.longest(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist()))
            yield pa.array([r and {"labels": len(_labels(r.host)), "chars": len(r.path), "blocks": r.verdict == "block",
                                   "rule": r.host + r.path} for r in found],
                           pa.struct([("labels", pa.int32()), ("chars", pa.int32()), ("blocks", pa.bool_()), ("rule", pa.string())]))

    return match


def judged(rows: DataFrame, rules: Iterable[str | Rule], url: str = "url", default: str = DEFAULT,
           max_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """Every row as ``row`` with its host, path, rule (null: none fits) and verdict (the rule's, else ``default``).

    Only hosts and paths travel to Python; no shuffle. Lists of rules above ``max_bytes`` are met part by part, each in a
    pass of its own over the written result of the one before, and the longest match of all parts counts. A null URL, or
    one without ``://``, has an empty host and path; a URL without a path is fitted by rules of an empty path only.
    Repeated rows stay repeated, columns of any name lie untouched in ``row``, an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), host.alias("host"), path.alias("path"))
    best: Column = F.lit(None).cast(MATCH)
    for k, part in enumerate(parts(rules, max_bytes)):
        if k:
            out = staged(out.select("row", "host", "path", best.alias("best")), "urls")
        found = _matcher(rows.sparkSession, part)("host", "path")
        best = F.greatest(F.col("best"), found) if k else found
    out = out.select("row", "host", "path", best.alias("best"))
    return out.select("row", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best").isNull(), default)
                      .when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"))


def allowed(rows: DataFrame, rules: Iterable[str | Rule], url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The rows whose URL is not blocked, with the columns they had."""
    return judged(rows, rules, url, default).where("verdict = 'allow'").select("row.*")


RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, RULES).select("row.page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
WITH rules(verdict, host, path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT page_id, strpos(url, '://') AS mark, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
parsed AS (
    SELECT page_id,
           CASE WHEN mark > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
           CASE WHEN mark > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM cut),
fitting AS (
    SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY p.page_id ORDER BY len(string_split(r.host, '.')) DESC NULLS LAST, length(r.path) DESC) AS place
    FROM parsed p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM fitting WHERE place = 1
"""
