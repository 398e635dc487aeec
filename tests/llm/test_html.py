import itertools
import random
import re
from html import unescape

import numpy as np

from riskloom.llm import html
from tests.llm.conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><b>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1><p>By someone</p></header><p>First  <b>bold</b>
 text<br>more &copy; 2 &lt; 3<p>Second <i>para</p><div class="ad">Buy</div><ul><li>item one<li>item two</ul><!-- note <p>x</p> -->
<section id="comments"><p>Nice post</p></section><form><label>Mail</label></form></article><aside>Aside</aside><footer>Foot</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE, np.zeros(9)) == "Head & line\nFirst bold text more © 2 < 3\nSecond para\nitem one\nitem two"


def test_cut_off_pages():
    for text, want in (("<article><p>a &am", "a &am"), ("<article><p>a<foot", "a"), ("<article>a < b", "a < b"), ("<article>a<script>x", "a"), ("<article>a<!-- x", "a"), ("", ""), (None, "")):
        assert html.main_text(text, np.zeros(9)) == want


def test_flow_gives_the_minimum_cut():
    pick = random.Random(3)
    for _ in range(150):
        n = pick.randrange(2, 9)
        excess = [pick.uniform(-3, 3) for _ in range(n)]
        joins = [(a, b, pick.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if pick.random() < 0.5]
        cost = lambda side: sum(-e for e, s in zip(excess, side) if e < 0 and s) + sum(e for e, s in zip(excess, side) if e > 0 and not s) + sum(
            c for a, b, c in joins if side[a] != side[b])
        cut = html.Cut(list(excess))
        for join in joins:
            cut.join(*join)
        assert abs(cost(cut.source_side()) - min(cost(s) for s in itertools.product((False, True), repeat=n))) < 1e-6


def test_without_statements_features_and_neighbours_decide(spark):
    weights = html.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    prose = "The quick brown fox jumps over the lazy dog, and then it rests for a while. " * 4
    page = "<body><ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(8)) + "</ul><div>" + f"<p>{prose}</p>" * 4 + "</div><ul><li><a href=z>More</a></li></ul></body>"
    assert html.main_text(page, weights) == "\n".join([prose.strip()] * 4)


PROSE = "The quick brown fox jumps over the lazy dog, and then it rests for a while. " * 3


def test_wrapper_names_do_not_decide(spark):
    weights = html.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    text = "\n".join([PROSE.strip()] * 3)
    paragraphs = f"<p>{PROSE}</p>" * 3
    for page in (f"<div class='layout has-sidebar'><article>{paragraphs}</article></div>", f"<div id='search-results-page'><main>{paragraphs}</main></div>",
                 f"<div class='sidebar'><article>{paragraphs}</article></div>", f"<div class='related-work'>{paragraphs}</div>",
                 f"<article><section class='related-work'>{paragraphs}</section></article>", f"<article><section id='search-algorithms'>{paragraphs}</section></article>"):
        assert html.main_text(page, weights) == text
    for page in (f"<aside><article>{paragraphs}</article></aside>", f"<article>{paragraphs}<div class='site-footer'><a href=x>Terms</a></div><div class='nav-bar'><a href=y>Home</a></div></article>"):
        assert html.main_text(page, weights) == ("" if page.startswith("<aside") else text)


def test_pages_without_any_statement_come_out_alike(spark):
    """The given pages with every container made a nameless one: classifier and cut find what the statements say."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html]
    weights = html.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    bare = lambda h: re.sub(r"<(/?)(?:nav|header|footer|aside|form|article|main|section)\b[^>]*>", r"<\1div>", re.sub(r"\b(class|id|role)=\S+?(?=[ >])", "", h))
    same = 0
    for page in pages:
        assert not any(b.evidence > 0 for b in html.blocks(bare(page)))
        same += html.main_text(page, weights) == html.main_text(bare(page), weights)
    assert same >= 0.9 * len(pages)


def test_statements_are_finite():
    """Strong odds of the text and its neighbours outweigh the name of a container."""
    found = html.blocks(f"<article>{f'<p>{PROSE}</p>' * 2}<div class='widget'><p>{PROSE}</p></div></article>")
    weights = np.zeros(9)
    weights[0] = html.MOST_ODDS
    assert [b.evidence for b in found] == [html.BY_ELEMENT] * 2 + [-html.BY_NAME] and all(html.labels(found, weights))
    assert html.labels(found, np.zeros(9)) == [True, True, False]


def test_other_elements_keep_their_text_in_line():
    page = "<article><p>Let <math><mi>x</mi>=<mi>y</mi></math> hold.<p>A <object>plain <svg><text>drawing</text></svg></object> here<noscript><p>Shown</p></noscript><script>no</script><style>no</style></article>"
    assert html.main_text(page, np.zeros(9)) == "Let x=y hold.\nA plain drawing here\nShown"


def test_deep_nesting_takes_linear_time():
    import time
    seconds = []
    for n in (4_000, 16_000):
        started = time.process_time()
        assert html.blocks("<div>x" * n + "</b></section>" * n + "</div>" * n)
        seconds.append(time.process_time() - started)
    assert seconds[1] < 9 * seconds[0] + 1


def test_query_against_the_template(spark):
    """The given pages have one <article>; its blocks are all of the main text."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html.op7_html_min_cut(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.DOTALL)[1]
        want = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", inner))]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", PAGE), (2, "u", ""), (2, "u", ""), (3, "v", "<article>" + "<p>long text " * 20_000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.url, len(r.text)) for r in html.extract(df).collect()}
    assert got == {(1, None, 0), (None, "u", len(html.main_text(PAGE, np.zeros(9)))), (2, "u", 0), (3, "v", 20_000 * 10 - 1)}
    assert html.extract(df.limit(0)).count() == 0
