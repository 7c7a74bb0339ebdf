"""Main-text extraction: the labelling against all labellings, pages without helpful names, and odd or very large pages."""

import time
from itertools import product

import numpy as np
import pytest

from evidentia.llm import htmltext

PROSE = "The quiet harbour woke before the bell. Nine boats left with the tide and four came back by noon. Nobody on the quay asked where the others had gone."
MENU = "<div><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li><li><a>News</a></ul></div>"
FOOT = "<div>© 2024 Some Site · <a>Terms</a> · <a>Imprint</a></div>"
#: No element, class or id here says what is content; the short paragraphs are content only by where they stand.
STORY = f"<h1>A tide</h1><p>{PROSE}</p><p>Yes.</p><p>No one answered</p><p>{PROSE}</p><p>Nine</p><p>{PROSE}</p>"
TOLD = f"A tide\n{PROSE}\nYes.\nNo one answered\n{PROSE}\nNine\n{PROSE}"


def cost(gain, edges, keep):
    return sum(abs(g) for g, k in zip(gain, keep, strict=True) if k != (g > 0)) + sum(c for a, b, c in edges if keep[a] != keep[b])


def by_brute_force(gain, edges):
    return min(cost(gain, edges, keep) for keep in product((False, True), repeat=len(gain)))


def test_labels_against_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = 9
        gain = rng.normal(size=n).tolist()
        edges = [(i, i + 1, float(rng.random())) for i in range(n - 1)] + [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (8, 2)) if a != b]
        keep = htmltext.label_blocks(gain, edges)
        assert abs(cost(gain, edges, keep) - by_brute_force(gain, edges)) < 1e-9


def test_a_settled_label_is_that_of_a_least_labelling():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 8
        gain = (rng.normal(size=n) * 2).tolist()
        edges = [(i, i + 1, float(rng.random())) for i in range(n - 1)] + [(i, i + 3, float(rng.random())) for i in range(n - 3)]
        label = htmltext.settled(gain, edges)
        best = by_brute_force(gain, edges)
        fitting = [k for k in product((False, True), repeat=n) if all(x is None or x == y for x, y in zip(label, k, strict=True))]
        assert abs(min(cost(gain, edges, k) for k in fitting) - best) < 1e-9


def test_the_cut_decides_on_pages_without_helpful_names():
    for around in ("{}{}{}", "<form>{}<div class='layout with-sidebar'>{}</div></form>{}", "<div id=a><div>{}</div><div>{}</div></div>{}"):
        html = "<html><body>" + around.format(MENU, f"<div class=x7>{STORY}</div>", FOOT)
        page = htmltext.Page(html)
        gain, edges = page.gains(), page.edges()
        keep = htmltext.label_blocks(gain, edges)
        assert abs(cost(gain, edges, keep) - by_brute_force(gain, edges)) < 1e-9
        assert any((g > 0) != k for g, k in zip(gain, keep, strict=True))
        assert htmltext.main_text(html) == TOLD


def test_edges_reach_beyond_the_next_block():
    page = htmltext.Page(f"<div><p>{PROSE}</p><div class=ad>Buy</div><p>{PROSE}</p></div>")
    assert (0, 2) in {(a, b) for a, b, _ in page.edges()}


@pytest.mark.parametrize("around", ["<aside>{}</aside>", "<div class='cookie-notice'>{}</div>", "<div id=comments><article class=comment>{}</article></div>", "<form>{}</form>", "<div hidden>{}</div>"])
def test_prose_in_boilerplate_goes(around):
    other = f"<p>{PROSE} {PROSE}</p>"
    assert htmltext.main_text(f"<body>{MENU}<article>{STORY}</article>{around.format(other)}{FOOT}") == TOLD
    assert htmltext.main_text(f"<body>{MENU}<article>{STORY}{around.format(other)}</article>{FOOT}") == TOLD


def test_main_stands_out_of_what_speaks_against_it():
    assert htmltext.main_text(f"<body><div class='notice banner'>{MENU}<main>{STORY}</main></div>{FOOT}") == TOLD


def test_given_pages(spark):
    """Of the given pages the article is the text; on some of them the cut changes labels."""
    changed = 0
    for row in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        page = htmltext.Page(row.html)
        gain = page.gains()
        keep = htmltext.label_blocks(gain, page.edges())
        assert keep == [b.hint == "main" for b in page.blocks]
        changed += sum((g > 0) != k for g, k in zip(gain, keep, strict=True))
    assert changed > 0


@pytest.mark.parametrize("html", [f"{'<div>' * 3000}<p>{PROSE}</p>" * 60, f"<div><p>{PROSE}</p><p>x</p>" * 6000, "<table>" * 3000 + "<td>x<p>y" * 20000, "<div>x y" * 30000, "<b><a>" * 50000, "<div a='" * 50000])
def test_large_and_deep_pages_take_time_in_proportion(html):
    began = time.perf_counter()
    assert isinstance(htmltext.main_text(html), str)
    assert time.perf_counter() - began < 8


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None, "u", 1), (1, "", "u", 2), (None, "  ", None, 3), (4, f"<article><p>{PROSE}</p>", "v", 4), (4, f"<article><p>{PROSE}</p>", "v", 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text int").withColumnRenamed("text", "TEXT")
    found = htmltext.extract(pages.drop("TEXT").withColumn("n_chars", pages.page_id))
    assert found.columns == ["page_id", "url", "n_chars", "text"]
    assert sorted(r.text for r in found.collect()) == ["", "", "", PROSE, PROSE]
    assert htmltext.extract(pages).columns == ["page_id", "url", "text"]
    assert htmltext.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("tag", ["svg", "object", "math", "canvas", "audio", "video"])
def test_what_is_never_closed_ends_at_the_next_block(tag):
    assert htmltext.main_text(f"<article><p>{PROSE}</p><{tag}><circle>drawn<p>{PROSE}</p></article>") == f"{PROSE}\n{PROSE}"
    assert htmltext.main_text(f"<article><p>{PROSE}</p><{tag}><p>inside</p></{tag}><p>{PROSE}</p></article>") == f"{PROSE}\n{PROSE}"


def test_many_unclosed_heads_take_time_in_proportion():
    took = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        htmltext.main_text("<head>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * max(took[0], 0.05)
