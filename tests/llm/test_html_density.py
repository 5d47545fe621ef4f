import html
import math
import random
import re
import time

import pytest

from symgraph.llm.html_density import Node, _measure, _walk, extract, main_text, parse

PARAGRAPHS = ["First paragraph of the story, long enough to count.", "Second one, with 3 < 4 &amp; so on — and more words.", "No.", "The last paragraph of the story, also long enough."]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n\n".join(html.unescape(p) for p in PARAGRAPHS)
AROUND = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>',
    "<header><h1>The Site</h1><p>A slogan for the site</p></header>",
    '<div class="sidebar"><h3>Latest</h3><ul><li>Something long that is not the article, in a list of things</li></ul></div>',
    '<aside>Aside text that is rather long and has no links in it at all, just words.</aside>',
    '<div id="cookie-notice">We use cookies. This is a notice of some length about cookies.</div>',
    '<div class="ad">Buy this very good thing now, while it lasts, at a good price.</div>',
    '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>',
    '<section class="comments"><h2>Comments</h2><div class="comment"><p>A reader says many things about the story, at length, for pages.</p></div></section>',
    "<footer>&copy; 2020 The Site &middot; All rights reserved and so on.</footer>",
    "<script>var t = '<p>not text</p>';</script><style>p{margin:0}</style><!-- <p>hidden</p> -->",
]


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="post"><div class="entry">%s</div></div>', '<div id="content">%s</div>'])
@pytest.mark.parametrize("order", [1, -1])
def test_only_the_article_stays(wrap, order):
    around = AROUND[::order]
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(around[:5]) + wrap % ARTICLE + "".join(around[5:]) + "</body></html>"
    assert main_text(page) == WANT


def test_title_in_the_article_and_its_own_header():
    assert main_text(f"<body><article><header><h1>Title</h1></header>{ARTICLE}<div class='share'>Share this</div></article></body>") == "Title\n\n" + WANT


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        ("<p>one<p>two<b>three<p>four", "one\n\ntwothree\n\nfour"),
        ("<article><p>a <i>b</i>\n\tc<br>d&nbsp;e &#x41;&lt;p&gt;</p></article>", "a b c d e A<p>"),
        ("<article><ul><li>x<li>y</ul><blockquote>q</blockquote>tail</article>", "x\n\ny\n\nq\n\ntail"),
        ("<article><p>open <b>bold</article><footer>f</footer>", "open bold"),
        ("<article><p>a</p></div></b></article>", "a"),
        ("<script>never closed <p>a", ""),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ],
)
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep words") == "deep words"
    assert main_text("<article><p>" + "word " * 100000 + "</p></article>") == ("word " * 100000).strip()


def test_query(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (None, None, None, None), (3, "v", "", "y")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_generated_pages_equal_a_plain_reading(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for row in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h\d)[^>]*>", article)]
        assert main_text(row.html) == "\n\n".join(filter(None, blocks))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_density_alone_finds_the_same_text(spark, sf):
    for row in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", row.html)
        assert main_text(plain) == main_text(row.html)


def test_densities_equal_the_formula():
    rng = random.Random(1)

    def made(depth):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.4 or depth > 4:
                parts.append("".join(rng.choice("ab c") for _ in range(rng.randint(1, 30))))
            elif kind < 0.6:
                parts.append(f"<a>{rng.choice(['x', 'some link', ''])}</a>")
            else:
                parts.append(f"<div>{made(depth + 1)}</div>")
        return "".join(parts)

    def text(node):
        return "".join(x if isinstance(x, str) else text(x) for x in node.inside).replace(" ", "")

    def links(node, inside=False):
        if node.tag == "a":
            return len(text(node))
        return sum(links(x) for x in node.inside if isinstance(x, Node))

    def density(node, body):
        below = list(_walk(node))[1:]
        chars, tags, link_chars, link_tags = len(text(node)), max(len(below), 1), links(node), sum(x.tag == "a" for x in below)
        if not chars:
            return 0.0
        ratio = links(body) / max(len(text(body)), 1)
        base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
        score = chars / tags
        return score * max(math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1)) / math.log(base), 0.0) if base > 1 else score

    for _ in range(60):
        body = parse(made(0))
        _measure(body)
        for node in _walk(body):
            assert node.density == pytest.approx(density(node, body))
            assert node.density_sum == pytest.approx(sum(density(x, body) for x in node.inside if isinstance(x, Node)))


def test_names_do_not_outweigh_the_text():
    assert main_text(f"<body><div class='post alerts'>{ARTICLE}</div><div class=ad>buy</div></body>") == WANT
    assert main_text(f"<body><article><p>Short.</p></article><div class=ad>{'buy now ' * 50}</div></body>") == "Short."
    assert main_text("<article><h1>T</h1><p title=it's>Hello ...</p><p>it's fine</p></article>") == "T\n\nHello ...\n\nit's fine"
    assert main_text('<article><p title="a > b" data-x=\'">\'>one</p><p =y "z>two</p></article>') == "one\n\ntwo"


@pytest.mark.parametrize("unit, end", [("word <b ", ""), ("<div>", "</p>"), ('<a x="', ">"), ("<div class=ad>", "<h1>t</h1>"), ("<b>", "<div></div>"), ("<script>", ""), ("<p><table><div>", "</p>"), ("<ul><li>", "<li>"), ("<", ""), ("<!--", ""), ("<a ", ">"), ("<a b='", "x>"), ("<i>", "</b>"), ("<textarea>x</textarea >", "")])
def test_hostile_pages_take_linear_time(unit, end):
    page = unit * (500_000 // len(unit)) + end * (500_000 // max(len(end), 1))
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 15
