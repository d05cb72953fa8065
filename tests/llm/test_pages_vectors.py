"""HTML extraction and top-k search against plain versions."""

import html
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from mnemospark.llm import html_extract, topk_search

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, do you agree?</div>
<article class="post"><h1>A <b>title</b> here</h1><p>First paragraph, with&nbsp;an entity &amp; a <a href="#">link</a>, which is long enough.<br>Next line.
<p>Second   paragraph; unclosed, yet long enough to matter. It has some sentences.<ul><li>item one</li><li>item two</li></ul><p>Hm.</p>
<div class="ad">Buy now, cheap!</div><form><label>Mail</label><input name=m></form></article>
<aside>Related: much text that is a sidebar, long, with commas, and more, and more.</aside>
<section id="comments"><p>A reader says something long, with commas, and so on, and so on, and so on.</p></section>
<footer>&copy; someone &middot; imprint</footer></body></html>"""


def test_article_of_a_page():
    assert html_extract.main_text(PAGE) == "A title here First paragraph, with an entity & a link, which is long enough. Next line. Second paragraph; unclosed, yet long enough to matter. It has some sentences. item one item two Hm."


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("   ", ""), ("<", "<"), ("plain & simple", "plain & simple"), ("<script>x", ""), ("<!-- c", ""), ("a < b and c > d", "a < b and c > d"), ("<p>a<b>b</b>c<p>d", "abc d"), ("<div><p>x &lt;y&gt;</p></div", "x <y>"), ("text <a href='", "text"), ("<nav>only menu</nav>", "")],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "content",
    [
        "<div id=content><h1>A title</h1><div class=lead>{0}{1}</div><div class=body>{2}{3}{4}{5}{6}{7}{8}{9}</div></div>",
        "<div id=content><h1>A title</h1><section>{0}</section><section>{1}{2}{3}{4}{5}{6}{7}{8}</section><section>{9}</section></div>",
        "<section><h1>A title</h1><div>{0}{1}{2}{3}{4}{5}{6}{7}</div><div>{8}</div><div>{9}</div></section>",
    ],
)
def test_blocks_beside_the_largest_one(content):
    texts = [f"Sentence {k} of the page, with commas, and with words that go on for long enough." for k in range(10)]
    page = "<body><div><a href=/>Home</a><a href=/x>More</a><a href=/y>Links</a></div>" + content.format(*(f"<p>{t}</p>" for t in texts)) + "<div>imprint</div></body>"
    assert html_extract.main_text(page) == " ".join(["A title", *texts])


def test_boxes_without_names_go_by_their_ratios():
    """No article, no class, no element that declares anything: only ratios tell."""
    texts = [f"Sentence {k} of the page, with commas, and with words that go on for {'long ' * (k % 7 + 1)}enough." for k in range(9)]
    menu = "<div>" + "".join(f"<span><a href=/{k}>Menu {k}</a></span> " for k in range(9)) + "</div>"
    body = "<div><h2>A title</h2>" + "".join(f"<p>{t}</p>" for t in texts[:5]) + "<p>Hm.</p><div>Buy it now</div>" + "".join(f"<p>{t}</p>" for t in texts[5:]) + "</div>"
    page = f"<html><body>{menu}<div>Advert of the day</div>{body}<div>imprint</div></body></html>"
    want = " ".join(["A title", *texts[:5], "Hm.", *texts[5:]])
    assert html_extract.main_text(page) == want
    # names that speak of a sidebar without being one, or that mislead altogether
    assert html_extract.main_text(page.replace("<div><h2>", "<div class='content no-sidebar'><h2>")) == want
    assert html_extract.main_text(page.replace("<body>", "<body class='sidebar menu'>")) == want


LONG = "<p>The rose is a flower, and people have grown it for ages; gardens hold it, poets name it.</p>"


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ('<p>The <span class="share-price">price of 12</span> rose, and then it fell.</p>', "The price of 12 rose, and then it fell."),
        ('<p>We look for <em class="search-term">whales</em> here, and often.</p>', "We look for whales here, and often."),
        ('<pre><code><span class="hljs-comment"># set x</span>\nx = 1</code></pre>', "# set x x = 1"),
        ('<pre><div class="comment"># set x</div><div>x = 1</div></pre>', "# set x x = 1"),
        ('<p>A <span class="comment">remark</span> within.</p>', "A remark within."),
        ('<div class="related-work"><p>Others have, before us, grown roses; they wrote about it.</p></div>', "Others have, before us, grown roses; they wrote about it."),
        ('<div class="form-of-government"><p>A republic, since the war, with two houses.</p></div>', "A republic, since the war, with two houses."),
        ('<p>So <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds, as shown.</p>', "So a=1 holds, as shown."),
        ('<div class="notice"><p>The plague came in 1348, and with it, as the notices said, an end to trade; few, if any, were left to tell.</p></div>', "The plague came in 1348, and with it, as the notices said, an end to trade; few, if any, were left to tell."),
        ('<div class="share-buttons">Share</div>', ""),
        ('<div class="ad-container">Buy it now, all of you, at last, for it is cheap, good, and ours; buy it, and buy more.</div>', ""),
        ('<div class="related-posts"><ul><li>Tulips</li><li>Lilies</li></ul></div>', ""),
        ('<section class="comments"><p>I liked it, said a reader, and so on, at length, for as long as there was room.</p></section>', ""),
        ('<form class="x">Mail</form><nav>Up</nav>', ""),
    ],
)
@pytest.mark.parametrize("around", ["article", "main"])
def test_names_within_an_article(part, text, around):
    page = f'<body><nav>Home</nav><{around}>{LONG}{part}{LONG}</{around}><div class="site-footer">Imprint</div></body>'
    rose = re.sub("<.*?>", "", LONG)
    assert html_extract.main_text(page) == " ".join(x for x in (rose, text, rose) if x)


def test_deep_nesting_keeps_text():
    for n in (100, 700, 5000):
        page = "<article>" + LONG + "<div>" * n + "<p>Deep down, there is more, and it counts.</p>" + "</div>" * n + LONG + "</article>"
        assert "Deep down, there is more, and it counts." in html_extract.main_text(page)


def test_ratios_decide(spark, sf_dir, monkeypatch):
    """Where pages declare their boilerplate, ratios change nothing; where they do not (the same
    pages with all elements of meaning made plain boxes), ratios give nearly all texts, and
    without them none is right."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/pages.parquet").collect()]
    want = [html_extract.main_text(p) for p in pages]
    bare = [re.sub(r'<(/?)(?:article|nav|footer)\b|<()div class="ad"', r"<\1div", p) for p in pages]
    right = sum(html_extract.main_text(p) == w for p, w in zip(bare, want, strict=True))
    assert right >= 0.9 * len(pages)
    even = lambda paths, texts, beside, claimed: ({p: float(not b) for p, b in zip(paths, beside, strict=True)}, 0.5)
    monkeypatch.setattr(html_extract, "path_values", even)
    assert not any(html_extract.main_text(p) == w for p, w in zip(bare, want, strict=True))
    assert sum(html_extract.main_text(p) == w for p, w in zip(pages, want, strict=True)) == len(pages)


class Nodes(HTMLParser):
    """Text nodes of well-formed pages by the standard library: path, section ids and text."""

    def __init__(self, page):
        super().__init__()
        self.open, self.nodes, self.count = [("", "", 0)], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.count += 1
        self.open.append((tag, tag + "".join("." + v for _, v in attrs if _ == "class"), self.count))

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if data.strip():
            sections = [k for t, _, k in self.open if t in ("", "html", "body", "div", "section")]
            self.nodes.append(("/".join(n for _, n, _ in self.open), sections, any("ad" == n.rpartition(".")[2] for _, n, _ in self.open), data))


def plain_main_text(page):
    nodes = Nodes(page).nodes
    if all(beside for _, _, beside, _ in nodes):
        return None
    by = {p: [t for q, _, _, t in nodes if q == p] for p, _, _, _ in nodes}
    size = lambda t: len(re.sub(r"\s", "", t))
    mean = lambda x: sum(x) / len(x)
    fused = {}
    for path, texts in by.items():
        sizes = [size(t) for t in texts]
        spread = mean([(n - mean(sizes)) ** 2 for n in sizes]) ** 0.5
        fused[path] = (mean(sizes) * (1 + mean([len(re.findall("[.,;:!?]", t)) for t in texts])) * (1 + spread)) ** 0.5
    line = [fused[p] for p, _, _, _ in nodes]
    padded = [line[0], *line, line[-1]]
    smoothed = [0.2 * padded[k] + 0.6 * padded[k + 1] + 0.2 * padded[k + 2] for k in range(len(line))]
    value = {p: mean([v for v, (q, _, _, _) in zip(smoothed, nodes, strict=True) if q == p]) for p in by}
    threshold = 0.6 * sum(value[p] * size(t) for p, _, _, t in nodes) / sum(size(t) for _, _, _, t in nodes)
    value |= {p: 0 for p, _, beside, _ in nodes if beside}
    content = {p for p in by if value[p] >= threshold} or {max(sorted(by), key=value.get)}
    holding = [set(s) for p, s, _, _ in nodes if p in content]
    inside = set.union(*holding) - set.intersection(*holding) | {max(set.intersection(*holding))}
    return " ".join(" ".join(t for p, s, beside, t in nodes if s[-1] in inside and (p in content or not beside)).split())


def test_equals_plain_ratios():
    r, other = random.Random(4), 0
    for _ in range(400):
        def block(depth):
            kind = r.choice(["div", "section", "p", "h2", "ul", "div class=ad", "div"] if depth < 4 else ["p", "h2", "ul"])
            words = lambda n: " ".join(r.choice(["one", "two,", "longer", "word.", "x"]) for _ in range(n))
            if kind in ("p", "h2"):
                return f"<{kind}>{words(r.choice([2, 5, 30, 60]))}</{kind}>"
            if kind == "ul":
                return "<ul>" + "".join(f"<li>{words(2)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
            inner = words(r.choice([0, 0, 3, 20])) + "".join(block(depth + 1) for _ in range(r.randint(0, 4)))
            return f"<{kind}>{inner}</{kind.split()[0]}>"

        page = "<html><body>" + "".join(block(0) for _ in range(r.randint(1, 5))) + "</body></html>"
        if Nodes(page).nodes and (want := plain_main_text(page)) is not None:
            assert html_extract.main_text(page) == want, page
            other += want != " ".join(" ".join(t for *_, t in Nodes(page).nodes).split())
    assert other >= 100


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "<p>core of it, at last.</p>" + "</div>" * 5000
    assert html_extract.main_text(deep) == "core of it, at last."
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    assert html_extract.main_text(long).count("word, word.") == 20_000


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract(odd).collect()
    assert [(r.text, r.n_chars) for r in rows] == [("", 0)] * 3
    assert html_extract.extract(pages.limit(0)).count() == 0
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", article)).split())
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want


def brute(vectors, every, k):
    rows = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, x in {(i, tuple(v)) for i, v in rows if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(x))
        for rank, (score, i) in enumerate(scores[:k], 1):
            out[(q, rank, i, -score)] += 1
    return out


@pytest.mark.parametrize("block", [2048, 60])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(150)]  # a very common vector: ties
    rows += [(900, None), (901, [None] + [0.0] * 7), (902, [float("nan")] * 8), (950, [float("inf")] * 8), (None, [1.0] * 8), (1000, [0.0] * 8), (1050, [1e6] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = topk_search.top_k(df, block=block, query_block=5)
    assert Counter(map(tuple, found.collect())) == brute(rows, 50, 5)


@pytest.mark.parametrize("kind", ["few weights", "plain", "copies", "large", "signs"])
def test_reading_stops_early_and_loses_nothing(kind):
    """Every query's best are those of the plain product; where few dimensions carry the scores
    most of the lists stay unread."""
    rng = np.random.default_rng(6)
    rows = np.floor(rng.normal(size=(3000, 16)) * 40)
    if kind == "few weights":
        rows[:, 2:] = np.floor(rows[:, 2:] / 40)
    elif kind == "copies":
        rows[100:2000] = rows[7]
    elif kind == "large":
        rows *= 2.0**40
    elif kind == "signs":
        rows[:, ::2] = -np.abs(rows[:, ::2])
    ids = rng.permutation(3000).astype(np.int64)
    queries = rows[:30].copy()
    queries[0] = 0
    q, c, s, read = topk_search.nra_top_k(ids, rows, ids[:30], queries, 5, group=1000)
    whole = 30 * rows.size
    assert read <= (0.35 if kind == "few weights" else 1) * whole
    exact = rows.astype(object) @ queries.T.astype(object)
    for j in range(30):
        held = lambda x: max(-(1 << 63), min((1 << 63) - 1, int(x)))
        want = sorted((-held(exact[i, j]), ids[i]) for i in range(3000) if i != j)[:5]
        assert [(-int(x), i) for x, i in zip(s[q == ids[j]], c[q == ids[j]], strict=True)] == want


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk_search.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk_search.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in topk_search.top_k(spark.createDataFrame([(0, [1.0]), (7, [0.5])], schema)).collect()] == [(0, 1, 7, 256 * 128)]
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 0.0])], schema)
    assert topk_search.top_k(huge).first().score == (1 << 63) - 1
