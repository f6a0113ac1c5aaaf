"""Elements without text of the page: what an open one and a formula leave to the labeller."""

import time

import pytest

from loomline.llm.html_text import extract, leaf_blocks, trained


@pytest.mark.parametrize("tag", "noscript template iframe svg canvas select datalist object math".split())
def test_open_element_drops_no_article(tag):
    texts = [t for _, t, _ in leaf_blocks(f"<body><p>before</p><{tag}><article><p>one</p><{tag}><p>two</p></article>")]
    assert texts == ["before", "one", "two"]


@pytest.mark.parametrize("tag", ["script", "style"])
def test_open_script_lasts_to_the_end(tag):
    assert [t for _, t, _ in leaf_blocks(f"<p>before</p><{tag}><p>one</p>")] == ["before"]


def test_closed_elements():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><object><p>in place</p></object><svg><text>no</text></svg><p>end</p>"
    assert [t for _, t, _ in leaf_blocks(page)] == ["Let x=2 hold.", "in place", "end"]


BROKEN = {
    "tags without an end": "<a " * 20_000, "quotes without an end": '<a x="' * 20_000, "mixed quotes": "<a \"'" * 20_000 + ">", "nested": "<div>x" * 20_000, "spans": "<span>" * 20_000 + "<p>x",
    "end tags out of scope": "<b>" + "<div>" * 20_000 + "</b>" * 20_000, "end tags of nothing": "</x>" * 20_000 + "<i>" * 20_000 + "</y>" * 20_000, "scripts": "<script>" + "</script " * 20_000,
    "many classes": "".join(f'<div class="{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}">x' for i in range(17_000)),
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_time_follows_length(name):
    """20,000 broken or nested tags take well under a second, as does twice as much of a page."""
    began = time.process_time()
    blocks = leaf_blocks(BROKEN[name])
    assert time.process_time() - began < 1.5 and all(len(p) <= 64 for p, _, _ in blocks)
    assert sum(t == "x" for _, t, _ in blocks) == BROKEN[name].count(">x")


def test_quotes_and_text_with_angles():
    texts = lambda page: [t for _, t, _ in leaf_blocks(page)]
    assert texts('<p title="a > b">one</p><p title="open>two</p>') == ["one", "two"]
    assert texts("1 < 2 <p>and 3 > 2</p> <a") == ["1 < 2", "and 3 > 2", "<a"]
    assert texts("<p>a<!-- x > <p> -->b<!-- open") == ["ab"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == list("abcde")


def test_names_that_are_taken_and_deep_pages(spark):
    df = spark.createDataFrame([(1, "n", 5, "<article><p>A paragraph of an article, with words.</p></article>"), (2, None, None, BROKEN["nested"]), (3, "", 0, None)], "page_id long, text string, N_chars int, html string")
    out = extract(df, keep=("page_id", "text", "N_chars"), model=trained(60, 1))
    assert out.columns == ["page_id", "text", "N_chars", "text_", "n_chars_"] and out.count() == 3
    assert {r["page_id"]: r["text"] for r in out.collect()} == {1: "n", 2: None, 3: ""}
