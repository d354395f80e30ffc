"""Main text of malformed, large and odd pages."""

from __future__ import annotations

import random
import time

import pytest
from test_llm import SF

from hirelake.llm import common, html_main

NOISE = ["<", ">", '"', "'", "(", ")", "/", " ", "=", "&", ";", "!", "[", "]", "\x00", "é", "<a", "<b(>", "</", "<!--", "-->", "<a)>x", "<foo(bar)>", "<script>", "<li>"]


def test_noised_pages_are_read(spark):
    pages = [r.html or "" for r in common.table(spark, SF, "pages").select("html").collect()]
    rng = random.Random(1)
    for _ in range(5000):
        page = list(rng.choice(pages)[:2000])
        for _ in range(rng.randint(1, 30)):
            at = rng.randrange(len(page) + 1)
            page[at : at + rng.randint(0, 3)] = [rng.choice(NOISE)]
        text, hashes = html_main.skeleton(html_main.parse("".join(page)))
        places = []
        todo = list(html_main._read(text))
        while todo:
            name, place, children, _ = todo.pop()
            places.append(place)
            todo += children
        assert sorted(places) == list(range(len(hashes)))


@pytest.mark.parametrize("piece", ["<a ", "<a<a", '<a "', "<a '\"", "<b>", "<b></i>", "<!--", "<li>", '<a b="c', "<"])
def test_large_malformed_pages_take_linear_time(piece):
    start = time.time()
    html_main.parse(piece * (500_000 // len(piece)))
    assert time.time() - start < 10


@pytest.mark.parametrize("tag", ["<a)>x", "<foo(bar)>y", "<b(>z</b(>", "<p <p", '<i "', "<x:y-z>w"])
def test_malformed_tags_beside_good_pages(spark, tag):
    page = "<html><body><nav>menu</nav><article><h1>Title {0}</h1><p>Some words of page {0}.</p>{1}</article></body></html>"
    rows = [(k, f"http://host/{k}", page.format(k, "")) for k in range(6)] + [(6, "http://host/6", page.format(6, tag)), (7, None, None), (8, "::", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    common.ship(spark)
    got = {r.page_id: r.text for r in html_main.extracted(df).collect()}
    assert len(got) == 9 and got[7] == got[8] == ""
    assert all(got[k] == f"Title {k} Some words of page {k}." for k in range(6))
    assert got[6].startswith("Title 6 Some words of page 6.")


def test_no_pages(spark):
    common.ship(spark)
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string, slot int")
    assert html_main.extracted(empty).count() == 0


def test_long_lists_are_aligned_in_parts(monkeypatch):
    rng = random.Random(2)
    body = lambda ks: "<body>" + "".join(f"<p class=c{'abcdefgh'[k % 8]}{'xyzw'[k // 8 % 4]}><b></b>{'<i></i>' * (k % 3)}</p>" for k in ks) + "</body>"
    one = [rng.randrange(400) for _ in range(60)]
    two = [k for k in one if rng.random() < 0.9]
    page, reference = (html_main.skeleton(html_main.parse(body(x)))[0] for x in (one, two))
    whole = html_main.aligned(page, reference)
    monkeypatch.setattr(html_main, "CELLS", 20)
    html_main.aligned.cache_clear()
    parts = html_main.aligned(page, reference)
    html_main.aligned.cache_clear()
    assert len(parts) > 0.8 * len(whole) and len(set(parts.values())) == len(parts)
    monkeypatch.undo()
    long = [html_main.skeleton(html_main.parse(body([rng.randrange(10_000) for _ in range(4000)])))[0] for _ in range(2)]
    start = time.time()
    assert html_main.aligned(*long)
    assert time.time() - start < 30


@pytest.mark.parametrize("cells", [1, 20, 1000])
def test_alignment_is_the_same_whatever_the_lengths(monkeypatch, cells):
    rng = random.Random(3)
    tree = lambda: f"{rng.choice('pqr')}({' '.join(f'{rng.choice("bi")}()' for _ in range(rng.randrange(4)))})"
    for _ in range(20):
        # No subtree occurs once in either list, so nothing but the whole table tells the largest matching.
        page, reference = (" ".join(2 * [tree() for _ in range(rng.randrange(1, 40))]) for _ in range(2))
        html_main.aligned.cache_clear()
        whole = html_main.aligned(page, reference)
        with monkeypatch.context() as m:
            m.setattr(html_main, "CELLS", cells)
            html_main.aligned.cache_clear()
            assert html_main.aligned(page, reference) == whole
    html_main.aligned.cache_clear()


def test_long_lists_have_the_largest_matching():
    # 600 x 600 trees of two labels without an equal one between them: the matching is the longest common sequence of labels.
    rng = random.Random(4)
    a, b = ([rng.choice("pq") for _ in range(600)] for _ in range(2))
    best = [0] * 601
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(best[j + 1], row[j], best[j] + (x == y)))
        best = row
    got = html_main.aligned(" ".join(f"{x}(b())" for x in a), " ".join(f"{y}(i())" for y in b))
    assert len(got) == best[-1]
