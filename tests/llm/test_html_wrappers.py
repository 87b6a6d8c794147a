import json
import random
import time

import pytest
from pyspark.sql import functions as F

from pagetables.llm.html_wrappers import _frozen, align, as_text, fold, host_wrappers, main_text, page_texts, read_page, slots
from tests.llm.data import prose

PAGES = "page_id bigint, url string, html string, host string"


def page(rng, paragraphs, **how):
    body = [prose(rng, rng.randrange(3, 30)) for _ in range(paragraphs)]
    head = prose(rng, 4)
    inner = "".join(f"<p>{t}" + ("</p>" if rng.random() < 0.7 else "") for t in body)
    html = (
        f"<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{{}}</style></head><body><script>var a='</p><p>no'</script>"
        f"<header><h1>Site</h1></header><nav><ul><li><a href=/x>x</a><li>y</ul></nav><!-- <p>no --><div class='side-bar left'>side <p>no</div>"
        f"<article><h2>{head}</h2>{inner}<div id=comments><p>reader says</div></article>"
        f"<aside>more</aside><form>name <input> <p>no</form><div class=ad>buy</div><footer>&copy; me</footer></body></html>"
    )
    return html, "\n".join([head, *body])


def test_article_text(spark):
    rng = random.Random(3)
    pages = [page(rng, rng.randrange(5)) for _ in range(40)]
    rows = [(i, f"https://h{i % 3}.example/{i}", html, "clash") for i, (html, _) in enumerate(pages)]
    found = {r["page_id"]: r for r in page_texts(spark.createDataFrame(rows, PAGES)).collect()}
    for i, (_, text) in enumerate(pages):
        assert found[i]["text"] == text and found[i]["n_chars"] == len(text)
        assert found[i]["url"] == rows[i][1]


def test_design_slots_are_left_out_without_an_article(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(12):
        body = prose(rng, 12)
        rows.append((i, "http://one.example/p", f"<body><div class=top>Our site</div><div class=text><p>{body}<p>same</div><div>All rights</div>", ""))
        want[i] = f"{body}\nsame"
    rows.append((50, "http://two.example/p", "<body><div class=top>Our site</div><p>only page", ""))
    want[50] = "Our site\nonly page"
    assert {r["page_id"]: r["text"] for r in page_texts(spark.createDataFrame(rows, PAGES)).collect()} == want


def test_references_space_and_blocks():
    html = "<main><p> a&nbsp;&amp;\n\t b<br>c<b>d</b>e &lt;x&gt; &#233;&#x1F600;</p>tail<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>"
    assert main_text(html) == "a & b cde <x> é\U0001f600\ntail\n1\n2\n3\n4"


def test_quoted_and_broken_tags():
    assert main_text('<p title="a > b">x</p> 1 < 2 <p title=\'>">\'>y<p it\'s>z</p><div') == "x\n1 < 2\ny\nz"
    assert main_text("a<!-- b") == "a"
    assert main_text("a<script>b") == "a"
    assert main_text("<title>t<p>a") == "t\na"


@pytest.mark.parametrize("piece", ["<p>", "<b ", "<!--", "<svg>", "<title>", "<a b='", "<div class=\"", "</p", "<", "<li>", "<head>"])
def test_time_is_linear(piece):
    def seconds(n):
        start = time.perf_counter()
        read_page(piece * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 6 * seconds(10_000) + 0.2


def test_folding_and_alignment():
    text = lambda html: as_text(read_page(html)[1])
    assert text("<div>a</div><p>b<p>c<p>d") == "<div>(#) <p>(#)+"
    assert text("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl>((<dt>(#) <dd>(#))+)"
    one, two = read_page("<h1>a</h1><p>b")[1], read_page("<h1>a</h1><div>x</div><p>b<p>c")[1]
    assert as_text(align(one, two)) == "<h1>(#) <div>(#)? <p>(#)+"
    assert as_text(align(two, one)) == as_text(align(one, two))
    assert align(one, one) == one and fold(()) == ()
    assert sorted(slots(align(one, two))) == [("/div", False), ("/h1", False), ("/p", True)]


def test_wrapper_of_a_host_has_every_page(spark):
    rng = random.Random(8)
    rows = [(i, f"http://{'a' if i % 2 else 'B'}.example/", page(rng, i % 7)[0], None) for i in range(60)]
    for r in host_wrappers(spark.createDataFrame(rows, PAGES)).collect():
        assert r["pages"] == 30
        known = {path for path, _ in slots(_frozen(json.loads(r["wrapper"])))}
        for _, url, html, _ in rows:
            if url == f"http://{r['host'][0]}.example/" or url.lower() == f"http://{r['host']}/":
                assert {path for path, *_ in read_page(html)[0]} <= known


def test_awkward_pages(spark):
    rows = [(1, None, None, None), (None, "x", "", ""), (2, "http://h/", " \n", ""), (2, "http://h/", " \n", ""), (3, "http://[", "\x00<p>a" * 20_000, "")]
    frame = spark.createDataFrame(rows, PAGES).withColumn("design", F.lit("d")).withColumn("text", F.lit("t"))
    found = sorted((tuple(r) for r in page_texts(frame).collect()), key=str)
    long = "\n".join(["\x00", *["a\x00"] * 19_999, "a"])
    assert found == sorted([(1, None, "", 0), (None, "x", "", 0), (2, "http://h/", "", 0), (2, "http://h/", "", 0), (3, "http://[", long, len(long))], key=str)
    assert page_texts(frame.limit(0)).collect() == []


def test_deep_pages_do_not_stop_the_others(spark):
    deep = "<div>" * 5_000 + "bottom<p>end" + "</div>" * 2_000 + "later"
    rows = [(1, "http://h/", deep, ""), (2, "http://h/", "<article><p>fine</article>", ""), (3, "http://h/", "<div>" * 650, "")]
    found = {r["page_id"]: r["text"] for r in page_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {1: "bottom\nend\nlater", 2: "fine", 3: ""}


def test_many_unmatched_tags_in_a_deep_page():
    start = time.perf_counter()
    read_page("<div>" * 40_000 + "</p></section>" * 40_000 + "<ul>" + "<li>x" * 10_000)
    assert time.perf_counter() - start < 20


def test_unclosed_silent_elements_end_at_the_next_block():
    for tag in ("button", "select", "svg", "audio", "video", "iframe", "noscript", "template"):
        assert main_text(f"<article><p>one</p><{tag}>x<p>two</p><p>three</p></article>") == "one\ntwo\nthree"
        later = f"<article><p>one</p><{tag}>x<p>two</p></article><footer><{tag}>y</{tag}></footer>"
        assert main_text(later) == "one\ntwo"
        assert main_text(f"<article><p>one <{tag}>x<b>y</b></{tag}> two</p></article>") == "one two"


def test_inline_content_stays():
    assert main_text("<article><p>Let <math><mi>x</mi></math> be</p><object>o</object><canvas>c</canvas></article>") == "Let x be\noc"


def test_names_of_articles():
    assert main_text('<article class="alert"><p>storm</article>') == "storm"
    assert main_text('<article><div class="social-study"><p>a</div><div class="social-links">b</div><div class="share">c</div></article>') == "a"
    assert main_text("<main><p>the long main text</main><article>teaser</article>") == "the long main text"
    assert main_text("<main>menu</main><article>the long article text</article>") == "the long article text"
    assert main_text('<article>a<article class="comment">says</article></article>') == "a"


def test_copies_of_a_page_are_no_design(spark):
    html = "<body><h1>Title</h1><div class=x><p>body</div>"
    rows = [(i, "http://copies.example/", html + "<nav>" + str(i) + "</nav>", "") for i in range(9)]
    assert {r["text"] for r in page_texts(spark.createDataFrame(rows, PAGES)).collect()} == {"Title\nbody"}
