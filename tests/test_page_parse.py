
import page_model as PP
from conftest import SF_ORACLE
from rollcall.functions import links as LK
from rollcall.operators import validation as V
from rollcall.plans.catalog_links import fetched_pages
from rollcall.plans.views import Programme


def test_fixture_case_b6():
    html = ('<button aria-label="Like this article"><span class="_card-action-text_a1">12</span></button>'
            '<button aria-label="Comment on this article"><span class="i">x</span><span>3</span></button>')
    assert PP.read_page(html) == (False, 12, 3)
    assert PP.read_page("<p>nothing</p>") == (False, 0, 0)
    assert PP.read_page("<title>404 Page</title><p>x</p>")[0] is True


def test_action_span_without_digits_has_no_fallback():
    html = ('<button aria-label="like this article"><span class="_card-action-text">Like</span>'
            '<span>7</span></button>')
    assert PP.read_page(html)[1] == 0


def test_nested_text_in_spans():
    html = '<button aria-label="Comment on this article"><span><b>4</b></span></button>'
    assert PP.read_page(html)[2] == 4


def test_regex_reading_matches_exact_reading_on_pages(spark):
    pages = fetched_pages(Programme(spark, SF_ORACLE))
    fast = V.page_signals(pages, plain_window=LK.PLAIN_TEXT_WINDOW,
                           rendered_window=LK.RENDERED_SOURCE_WINDOW)
    exact = {r.link: PP.read_page(r.html, r.status) for r in pages.collect()}
    assert {r.link: (r.missing, r.page_likes, r.page_comments) for r in fast.collect()} == exact
    assert len(exact) == pages.count()
