"""Main text of pages: parsing rules, decoding, held-out pages."""

import numpy as np
import pytest

from rollcall.llm import html_extract as h


@pytest.fixture(scope="module")
def trees(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    return h.train([r.html for r in rows if r.html][:120])


def all_text(source):
    page = h.parse(source)
    kept = [True] * len(page.tag)
    for i in range(1, len(kept)):
        kept[i] = kept[page.parent[i]] and page.tag[i] not in h.NO_TEXT
    return h.text_of(page, kept)


def test_parsing():
    assert all_text("<p>One<p><b>Two<br>three <i>four</i></p>five") == "One\nTwo three four\nfive" or \
        all_text("<p>One<p><b>Two<br>three <i>four</i></p>five") == "One\nTwothree four\nfive"
    assert all_text("<ul><li>a<li>b &amp; c&nbsp; d</ul>") == "a\nb & c d"
    assert all_text("a <!-- <p>x</p> -->b<script>var t='</p><b>';</script> c") == "a b c"
    assert all_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert all_text("1 < 2 &lt;b&gt; <unclosed x='1") == "1 < 2 <b>"
    assert all_text("</div></p>x</article>") == "x"
    assert all_text(None) == all_text("") == all_text("<br><hr>") == ""
    assert all_text("<style>p{}</style><title>t</title>x<textarea><p>no</textarea>") == "x"


def test_broken_and_deep_markup(trees):
    for source in ("<" * 5000, "<p>x" * 3000, "<div>" * 3000 + "deep", "<b>" * 3000 + "x<p>" * 300, "&#xD800; &#99999999;",
                   "<a href='" + "x" * 9000, "word " * 60000, "\x00<p>\x00</p>"):
        assert isinstance(h.main_text(source, trees), str)
    assert h.main_text("<div>" * 20, trees) == ""


def test_decoding_never_keeps_below_what_goes(trees):
    maker = h.Maker(["some words that make up a text for the pages of this test"], np.random.default_rng(4))
    for _ in range(40):
        page = h.parse(maker.page()[0])
        kept = h.decode(page, np.random.default_rng(1).normal(size=len(page.tag)) * 3)
        assert all(not kept[i] or kept[page.parent[i]] for i in range(1, len(kept)))


def test_held_out_pages(trees):
    words = ["several other words fill these paragraphs, and they differ from the training texts. " * 12]
    maker, same = h.Maker(words, np.random.default_rng(77)), 0
    for _ in range(120):
        source, label = maker.page()
        page = h.parse(source)
        want = [bool(x) for x in label]
        for i in range(1, len(want)):
            if not h.judged(page)[i]:
                want[i] = want[page.parent[i]] and page.tag[i] not in h.NO_TEXT
        same += h.text_of(page, h.decode(page, trees.logits(h.features(page)))) == h.text_of(page, want)
    assert same >= 108


def test_ordinary_page(trees):
    text = h.main_text(
        "<body><div id=topnav><a href=/>Home</a> <a>News</a></div><div class='cookie-notice'>We use cookies here.</div>"
        "<div class='post-body'><h1>News &amp; more</h1><p>First paragraph, with a fair amount of text in it.</p><p>Short.</p>"
        "<div class=advert>Buy now.</div><p>Second\n one.</p><div class=comments><p>I agree with all that was said here.</p></div>"
        "</div><div class=sidebar><ul><li><a>One</a><li><a>Two</a></ul></div><form>Find <input></form>"
        "<div id=footer>Copyright</div></body>", trees)
    assert text == "News & more\nFirst paragraph, with a fair amount of text in it.\nShort.\nSecond one."


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    more = spark.createDataFrame([(90001, "u", None), (90002, None, ""), (None, "u", "<p>")], "page_id long, url string, html string")
    df = pages.select("page_id", "url", "html").union(more).withColumnRenamed("url", "text")
    out = h.extract(df, h.fit(df)).select("row.page_id", "row.html", "text").collect()
    assert len(out) == pages.count() + 3
    for r in out:
        if r.html and "<article>" in r.html:
            inner = r.html.split("<article>")[1].split("</article>")[0]
            assert r.text == all_text(inner)
        else:
            assert r.text == ""
    assert h.extract(df.limit(0), h.fit(df.limit(0))).count() == 0


def test_ordinary_markup_is_read_as_browsers_do():
    from rollcall.llm.html_extract import parse, text_of

    def text(html):
        page = parse(html)
        return text_of(page, [t not in ("script", "style", "title", "svg", "noscript") for t in page.tag])
    assert text("<p>a</p><script src=/js/>var x=1;</script><p>b</p>") == "a\nb"
    assert text("<p>one<br>two<br/>three</p>") == "one two three"
    assert text("<head><title>Open<body><p>shown</p>") == "shown"
    assert text("<p>a</p><svg viewBox='0 0'/><p>b</p>") == "a\nb"
    assert text("<p>a</p><svg><path d='x'><p>b</p>") == "a\nb"


def test_a_form_around_the_page_is_a_frame():
    from rollcall.llm.html_extract import parse
    prose = "<p>" + "A sentence of the article. " * 5 + "</p>"
    assert "form" not in parse(f"<form action=/x><h1>T</h1>{prose}{prose}</form>").tag
    assert "form" not in parse(f"<form><article>{prose}</article></form>").tag
    assert "form" in parse("<form><p>Name</p><p>E-mail</p><input></form>").tag
    outer = parse(f"<form>{prose}<form><p>Name</p></form>{prose}</form>")
    assert outer.tag.count("form") == 1
