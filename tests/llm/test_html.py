"""Labelling by minimum cut: against all labellings, and on pages where only the cut is right."""

import random
import time

import pytest

from strandline.llm import html

LONG = "A paragraph of a page that says a lot about its subject, goes on for quite a while, and ends as sentences do, with a full stop in the end."


def test_cut_against_all_labellings():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 9)
        gain = [rng.choice([0.0, 0.0, rng.uniform(-3, 3), -1e6]) for _ in range(n)]
        links = [(i, j, rng.choice([0.25, 1.0, 2.0, rng.uniform(0, 1.5)])) for i in range(n) for j in range(i + 1, n) if rng.random() < rng.choice([0.2, 0.5])]
        cost = lambda s: sum(max(g, 0) if not s >> i & 1 else max(-g, 0) for i, g in enumerate(gain)) + sum(c for i, j, c in links if (s >> i & 1) != (s >> j & 1))  # noqa: B023, E731
        side = html.minimum_cut(gain, links)
        assert cost(sum(x << i for i, x in enumerate(side))) == pytest.approx(min(map(cost, range(1 << n))), abs=1e-6)


def test_the_cut_decides():
    page = f"""<body><div><a href=a>One</a> <a href=b>Two</a></div>
    <div class="post"><h2>Head</h2><p>Short</p><p>{LONG}</p><div>Aside from that</div><p>{LONG}</p><ul><li>first<li>second<li>third</ul></div>
    <div><div><a href=c>{LONG}</a></div><div>{LONG[:60]}</div><a href=d>Three</a><a href=e>Four</a></div></body>"""
    moved = [b.text for b, keep in html.labelled(page) if keep != (html.evidence(b) > 0)]
    assert {"Head", "Aside from that"} <= set(moved)
    assert html.main_text(page) == f"Head\nShort\n{LONG}\nAside from that\n{LONG}\nfirst\nsecond\nthird"


def test_long_lists_stay():
    items = [f"item {i}" for i in range(60)]
    for box in ("article", "div class=content"):
        assert html.main_text(f"<{box}><p>{LONG}</p><ul><li>{'<li>'.join(items)}</ul></{box.split()[0]}>") == "\n".join([LONG, *items])
        linked = f"<{box}><p>{LONG}</p><ul>{''.join(f'<li><a href=x>{i}</a>' for i in items)}</ul></{box.split()[0]}>"
        assert html.main_text(linked) == LONG


def test_names_are_evidence():
    for name in ("legal", "more", "tags", "trending", "search", "rail", "post-header", "no-sidebar", "with-ads"):
        assert html.main_text(f'<article><p>{LONG}</p><div class="{name}"><p>{LONG} 2</p><p>{LONG} 3</p></div></article>').count("\n") == 2, name
    for name in ("siteFooter", "article-comments", "comment-body", "cookie-banner", "sidebar-content", "main-nav", "ad"):
        assert html.main_text(f'<article><p>{LONG}</p><div class="{name}"><p>{LONG} 2</p><p>{LONG} 3</p></div></article>') == LONG, name
    assert html.main_text(f"<article><header><h1>Its title</h1></header><p>{LONG}</p><footer>{LONG}</footer></article>") == f"Its title\n{LONG}"
    assert html.main_text(f"<header><h1>The site</h1></header><p>{LONG}<p class=it's>{LONG}") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a x=">" ' * 100_000, "<div>" * 100_000 + "x", "<div><p>some text" * 40_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<" * 1_000_000, "<!--" * 200_000, "<p>short text." * 40_000, '<div class="' * 80_000])
def test_time_of_broken_pages(page):
    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 8


def test_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, f"<p>{LONG}", "y"), (2, "v", "", None), (2, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (0, None, LONG, len(LONG)), (2, "v", "", 0), (2, "v", "", 0)], key=str)
    assert html.extract(pages.limit(0)).count() == 0
