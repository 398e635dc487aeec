"""Main text of web pages by minimum cut.

A page is cut into blocks of text in page order. A classifier gives each block a cost of being called content and a cost of
being called boilerplate; these are the capacities of its edges to the two terminals. Neighbours in page order and blocks
close in the DOM are joined by smoothness edges. The minimum cut labels all blocks of the page at once.

The classifier is a logistic regression over text and layout features, trained on blocks whose place in the page states
what they are (inside <article> or <main>; inside <nav>, <footer>, <aside>, <form>, or a container named as one). Such a
statement adds to the capacity of a block's terminal edge, by elements more than by names, but within the size of what the
classifier may say, so that text and neighbours can outweigh it; blocks without one go by features and neighbours alone.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr math svg object noscript canvas".split())
FOREIGN = frozenset("math svg".split())
RAW = frozenset("script style template textarea iframe".split())
BOILERPLATE = frozenset("head title nav header footer aside form button select option dialog menu figure-menu".split())
CONTENT = frozenset("article main".split())
# Words in class, id and role names that state what a container holds.
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related "
    "recommended share sharing social newsletter subscribe signup login search comment comments reply replies respond disqus "
    "discussion contentinfo complementary toolbar pagination pager copyright".split())
CONTENT_NAMES = frozenset("article main post entry story articlebody postcontent entrycontent maincontent".split())
# Words that may stand beside one of these in a name and say nothing.
NEUTRAL_NAMES = frozenset("site page top bottom left right global box bar block list area section container wrapper inner outer unit slot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Pages the classifier is fitted on at most.
FIT_PAGES = 2000
#: What an element and what a name adds to a terminal edge, and the most that the classifier does.
BY_ELEMENT, BY_NAME, MOST_ODDS = 8.0, 6.0, 8.0
#: Capacity between neighbours in page order, and more for each neighbour under the same parent.
ADJACENT, SIBLING = 0.6, 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_CUT_OFF = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


class Block:
    __slots__ = ("text", "tag", "parent", "depth", "linked", "evidence")

    def __init__(self, text: str, tag: str, parent: int, depth: int, linked: int, evidence: float) -> None:
        self.text, self.tag, self.parent, self.depth, self.linked, self.evidence = text, tag, parent, depth, linked, evidence


def _named(attributes: str) -> int:
    """What the names of a container state: -1 boilerplate, 1 content, 0 nothing. A name of several words counts if all do."""
    found = 0
    for attribute in _NAMES.finditer(attributes):
        for name in (attribute[1] or attribute[2] or attribute[3] or "").lower().split():
            words = set(re.split(r"[_-]+", name)) - NEUTRAL_NAMES - {""}
            joined = name.replace("-", "").replace("_", "")
            if joined in BOILERPLATE_NAMES or words and words <= BOILERPLATE_NAMES:
                return -1
            if joined in CONTENT_NAMES or words and words <= CONTENT_NAMES:
                found = 1
    return found


def _states(tag: str, attributes: str, outer: float) -> float:
    """What a block in this element may be, above zero content: the innermost statement. Elements of boilerplate hold no
    content; an article in a container that is only named as boilerplate is content."""
    if tag in BOILERPLATE or outer <= -BY_ELEMENT:
        return -BY_ELEMENT
    if tag in CONTENT:
        return BY_ELEMENT
    named = _named(attributes) if attributes and tag not in ("body", "html") else 0
    if not named or named > 0 and outer:
        return outer
    return named * BY_NAME


def blocks(html: str) -> list[Block]:
    """Blocks of a page in order. Markup that is cut off at the end of the page is no text."""
    out: list[Block] = []
    stack: list[tuple[str, float, int]] = [("", 0, 0)]  # name, what it states, number
    opened: Counter[str] = Counter()  # names in the stack
    parts: list[str] = []
    linked, in_link, number, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                depth = len(stack)
                while depth > 1 and stack[depth - 1][0] in INLINE:
                    depth -= 1
                name, _, own = stack[depth - 1]
                up = stack[depth - 2][2] if depth > 1 else own
                heading = name in HEADINGS and opened["header"] and any(opened[x] for x in CONTENT)
                # The headline of an article may stand in the article's own header.
                states = BY_ELEMENT if heading and not any(s[1] < 0 for s in stack[:_first_header(stack)]) else stack[-1][1]
                out.append(Block(text, name, up, depth, min(linked, len(text)), states))
            parts.clear()
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            data = unescape(html[at:end])
            parts.append(data)
            if in_link:
                linked += len(data)

    def close(depth: int) -> None:
        for entry in stack[depth:]:
            opened[entry[0]] -= 1
        del stack[depth:]

    while True:
        token = _TOKEN.search(html, at)
        if token is None:
            tail = _CUT_OFF.search(html, at)
            text_to(tail.start() if tail else len(html))
            break
        text_to(token.start())
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        foreign = any(opened[x] for x in FOREIGN)
        inline = name in INLINE or foreign
        if token[1]:
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name) if opened[name] else 0
            if not inline:
                flush()
            elif depth and not foreign and any(s[0] not in INLINE for s in stack[depth:]):
                continue  # an inline end tag does not close a block
            if name == "a":
                in_link = 0
            if depth:
                close(depth)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if not inline:
            flush()
            if name in ("li", "p", "option", "tr", "td", "th", "dt", "dd") or any(s[0] == "p" for s in stack[-4:]):
                closes = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}.get(name, ("p",))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        close(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
        if name in VOID or token[3].endswith("/"):
            continue
        if name == "a":
            in_link = 1
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        number += 1
        stack.append((name, stack[-1][1] if foreign else _states(name, token[3], stack[-1][1]), number))
        opened[name] += 1
    flush()
    return out


def _first_header(stack: list[tuple[str, int, int]]) -> int:
    return next((i for i, s in enumerate(stack) if s[0] == "header"), len(stack))


def features(found: list[Block]) -> np.ndarray:
    """A row per block: text and layout only, nothing of what its containers state."""
    rows = np.zeros((len(found), 9))
    for i, b in enumerate(found):
        n, spaces = len(b.text), b.text.count(" ")
        rows[i] = (1.0, min(np.log1p(n), 8) / 4, b.linked / n, min(spaces + 1, 100) / 50, sum(map(b.text.count, ".,;!?")) / (spaces + 1),
                   b.tag == "p", b.tag == "li", b.tag in HEADINGS, i / len(found))
    return rows


def trained(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression by gradient steps, both classes of equal weight; without both classes it decides nothing."""
    w = np.zeros(9)
    if len(y) and 0 < y.mean() < 1:
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        for _ in range(steps):
            w += 4 * (x.T @ (share * (y - 1 / (1 + np.exp(-x @ w)))) - 1e-3 * w)
    return w


class Cut:
    """Maximum flow by levels (blocking flows over shortest paths); vertices hold what they can still take from or give to a terminal."""

    def __init__(self, excess: list[float]) -> None:
        self.excess, self.edges = excess, [[] for _ in excess]  # an edge: target, capacity left, index of its reverse

    def join(self, a: int, b: int, capacity: float) -> None:
        self.edges[a].append([b, capacity, len(self.edges[b])])
        self.edges[b].append([a, capacity, len(self.edges[a]) - 1])

    def source_side(self) -> list[bool]:
        excess, edges = self.excess, self.edges
        while True:
            level = [0 if e > 1e-9 else -1 for e in excess]
            queue, reached = deque(i for i, e in enumerate(excess) if e > 1e-9), False
            while queue:
                v = queue.popleft()
                for b, left, _ in edges[v]:
                    if left > 1e-9 and level[b] < 0:
                        level[b] = level[v] + 1
                        reached |= excess[b] < -1e-9
                        queue.append(b)
            if not reached:
                return [x >= 0 for x in level]
            following = [0] * len(excess)
            for start in [i for i, e in enumerate(excess) if e > 1e-9]:
                path: list[list] = []
                v = start
                while excess[start] > 1e-9:
                    if excess[v] < -1e-9 and path:
                        flow = min(excess[start], -excess[v], *(e[1] for e in path))
                        for e in path:
                            e[1] -= flow
                            edges[e[0]][e[2]][1] += flow
                        excess[start] -= flow
                        excess[v] += flow
                        path, v = [], start
                        continue
                    while following[v] < len(edges[v]):
                        e = edges[v][following[v]]
                        if e[1] > 1e-9 and level[e[0]] == level[v] + 1:
                            break
                        following[v] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        v = edges[e[0]][e[2]][0]
                        following[v] += 1
                        continue
                    path.append(e)
                    v = e[0]


def main_text(html: str | None, weights: np.ndarray) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    return "\n".join(b.text for b, content in zip(found, labels(found, weights), strict=True) if content)


def labels(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks of a page are content: the source side of its minimum cut."""
    odds = np.clip(features(found) @ weights, -MOST_ODDS, MOST_ODDS)
    cut = Cut([float(o) + b.evidence for o, b in zip(odds, found, strict=True)])
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            cut.join(i - 1, i, ADJACENT)
        if b.parent in last and last[b.parent] >= 0:
            cut.join(last[b.parent], i, SIBLING)
        last[b.parent] = i
    return cut.source_side()


def fit(pages: DataFrame, most: int = FIT_PAGES) -> np.ndarray:
    """Weights from about ``most`` pages, those whose html hashes below a bound that follows from their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column("html").to_pylist():
                found = blocks(html)
                y = np.array([b.evidence for b in found])
                yield pa.RecordBatch.from_arrays([pa.array([features(found)[y != 0].tobytes()], pa.binary()), pa.array([(y[y != 0] > 0).astype(np.float64).tobytes()], pa.binary())], ["x", "y"])

    given = pages.select(F.col("html").cast("string")).where("html is not null")
    bound = int((1 << 40) * min(1.0, most / max(given.count(), 1)))
    sample = given.where(F.pmod(F.xxhash64("html"), F.lit(1 << 40)) < bound)
    rows = sample.mapInArrow(run, "x binary, y binary").limit(2 * most).collect()  # the limit guards against pages that repeat
    return trained(np.frombuffer(b"".join(r.x for r in rows)).reshape(-1, 9), np.frombuffer(b"".join(r.y for r in rows)))


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url and the main text of every page.

    Null or empty html, and pages of boilerplate only, have an empty text. Null ids and urls pass through, repeated rows stay
    repeated, an empty table gives no rows; other columns are not read. Pages are taken on their own; nothing is shuffled.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(html, shared.value) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInArrow(run, "page_id long, url string, text string")


def op7_html_min_cut(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
