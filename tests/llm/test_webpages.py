"""Main text of pages against plain expectations, and on awkward pages."""

from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from labelweave.llm import webpages

PAGE = "page_id bigint, url string, html string"


def expected(source):
    """The article of the test pages, by their known template."""
    body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", source, re.S)[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_pages_of_the_test_table(spark, broadcast):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in webpages.extract_pages(pages, broadcast).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == expected(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


LAYOUT = """<!DOCTYPE html><HTML><head><title>Site &amp; title</title><meta name=x content="a>b"><script>if (a<b) document.write("<p>no</p>")</script>
<body class="with-sidebar home"><div id=wrap class='page has-comments'><header><h1>My site</h1></header><div role=navigation>Go</div>
<div class="cookie-notice">We use cookies</div><main id="main-2"><article class="post"><header><h1>Title {0}</h1><span class=byline>By X</span></header>
<p>First&nbsp;one {0} &lt;tag&gt; <em>em</em>bed<br>line <!-- <p>gone</p> --><p>Second {0}<ul><li>item one<li>item two</ul>
<aside>Related: other</aside><form><label>Mail</label><button>Send</button></form><table><tr><td>a{0}<td>b</table>
<div class=k>Read it aloud</div><div hidden>secret</div><div style="display: none">none</div><div class="share-box">Share this</div></article>
<section id="comments"><article class="comment"><p>Nice post {0}!</article></section></main><div class=sidebar><p>Popular</div></div><footer>(c)</footer>"""
TEXT = "Title {0} First one {0} <tag> embed line Second {0} item one item two a{0} b"


def test_elements_that_are_no_part_of_the_article(spark):
    assert webpages.main_text(LAYOUT.format("x1")) == TEXT.format("x1") + " Read it aloud"
    rows = [(i, f"http://h.example/{i}", LAYOUT.format(f"w{i}")) for i in range(6)]  # the nameless box repeats on every page
    got = webpages.extract_pages(spark.createDataFrame(rows, PAGE)).collect()
    assert {r.page_id: r.text for r in got} == {i: TEXT.format(f"w{i}") for i in range(6)}


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def nameless(i, host):
    """A page whose classes say nothing: only the site's tree tells its parts."""
    body = [" ".join(WORDS[(i * 7 + k * 3 + j * j) % 20] + str(i * 31 + k * 5 + j) for j in range(9)) for k in range(4)]
    paragraphs = "".join(f"<p>{b}.</p>" for b in body)
    source = f"<body><div class=q1><a href=/a>Start</a><a href=/b>About us</a></div><div class=q2><h2>Text {WORDS[i % 20]}x{i}</h2>{paragraphs}</div><div class=q3>All rights by {host}. Write to us.</div></body>"
    return source, f"Text {WORDS[i % 20]}x{i} " + " ".join(b + "." for b in body)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_repeated_branches_of_a_site_go(spark, broadcast):
    rows, want = [], {}
    for i in range(24):
        host = "one.example" if i < 16 else "two.example"
        source, text = nameless(i, host)
        rows.append((i, f"https://{host}/p{i}?x", source))
        want[i] = text
    # no site of its own, so nothing repeats
    rows.append((24, None, nameless(0, "h")[0]))
    got = {r.page_id: r.text for r in webpages.extract_pages(spark.createDataFrame(rows, PAGE).repartition(5), broadcast).collect()}
    assert {i: got[i] for i in want} == want
    assert got[24].startswith("StartAbout us Text") and got[24].endswith("Write to us.")


def test_site_tree_entropies(spark):
    rows = [(i, "<body><div class=a>same words</div><div class=b>" + ("<p>one</p>" if i % 2 else "<ul></ul>") + f"<i>w{chr(97 + i)}</i></div>") for i in range(4)]
    df = spark.createDataFrame([(7, h) for _, h in rows], "site bigint, html string")
    tree = {r.node & (1 << 64) - 1: r for r in webpages.site_tree(df).collect()}
    page = webpages.Page(rows[0][1])
    nodes = dict(zip([m[0] for m in page.marks], webpages.paths(page, 7)))
    a, b, i = tree[nodes["div.a#"]], tree[nodes["div.b#"]], tree[nodes["i"]]
    assert (a.pages, a.content, a.styles) == (4, pytest.approx(0), 1)
    # two styles of two pages each: half of the largest entropy of four pages
    assert b.presentation == pytest.approx(0.5) and b.styles == 2
    assert i.content == pytest.approx(1) and a.presentation == pytest.approx(0)


def test_copies_keep_their_articles(spark):
    source = "<body><div class=z><section><p>A long article that is copied.</p><p>Second part of it.</p></section></div></body>"
    rows = [(i, "http://c.example/", source) for i in range(8)]
    rows += [(10 + i, "http://d.example/", f"<body><article>{source}</article></body>") for i in range(8)]
    got = webpages.extract_pages(spark.createDataFrame(rows, PAGE)).collect()
    assert len(got) == 16 and {r.text for r in got} == {"A long article that is copied. Second part of it."}


def test_awkward_pages(spark):
    rows = [
        (1, "http://a.example", None), (2, "http://a.example", ""), (3, "nohost", " \n "), (None, None, None), (4, "http://a.example", "plain < text & more"),
        (4, "http://a.example", "plain < text & more"), (5, "", "<p>open <b>bold <p>next</b> </i> </div> &#x41;&bogus;"), (6, "http://b.example", "<div>" * 20_000 + "deep"),
        (7, "http://b.example", "<p class='unclosed>never ends"), (8, "ftp://u:p@Host.Example:80/x", "<script>never ends <p>no"), (9, "x://", "<!-- never ends <p>no"),
        (10, "http://é.example/", "<article>" + "<p>wörd &amp; " * 100_000), (11, "http://b.example", "</p></div></td><td>cell<svg><path d='1'/></svg>end"),
        (12, "http://b.example", "<article><p>it's <a title=don't>fine</a> so</article>"), (13, "http://b.example", "a\x00b<br/>c"),
    ]
    df = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("clash")).withColumn("_html", F.lit(1)).withColumn("n_chars", F.lit("x"))
    start = time.time()
    out = webpages.extract_pages(df).collect()
    assert time.time() - start < 60
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and sum(r.page_id == 4 for r in out) == 2
    assert got[1] == got[2] == got[3] == got[None] == got[7] == got[8] == got[9] == ""
    assert got[4] == "plain < text & more" and got[5] == "open bold next A&bogus;" and got[6] == "deep"
    assert got[10] == " ".join(["wörd &"] * 100_000) and got[11] == "cellend" and got[12] == "it's fine so" and got[13] == "a\x00b c"
    assert webpages.extract_pages(df.limit(0)).count() == 0


def test_hosts(spark):
    urls = ["http://A.example/x", "https://a.example:8080?q", "//a.example", None, "", "ftp://u:p@a.example/"]
    keys = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").orderBy("i").select(webpages.site_of()).collect()]
    assert keys[0] == keys[1] == keys[5] is not None and keys[2] is None and keys[3] is None and keys[4] is None
