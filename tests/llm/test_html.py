"""HTML extraction: templates counted by a plain version, markup that names nothing, and pages that are no HTML."""

import random
import time
from collections import defaultdict

import pytest

from plumbline.llm import html_main

SF = "/root/testdata/sf0.001"


def plain_templates(pages):
    """(host, subtree as a string) of what recurs in five parts; the parts are the pages, each known by its longest paragraph outside."""
    found = defaultdict(set)
    for url, nodes in pages:
        host = url.split("/")[2]
        for i, node in enumerate(nodes):
            paragraphs = [p for j, n in enumerate(nodes) if j != i for p in n[1]]
            found[host, str(node)].add(max(paragraphs, key=len, default=""))
    return {k for k, v in found.items() if len(v) >= 5}


def test_templates_are_the_counted_ones(spark):
    """Pages of unnamed divs: each goes if the plain count says so, and stays if not."""
    rng = random.Random(3)
    boxes = [("div", [f"Box number {i} of the site."]) for i in range(12)]
    pages = []
    for i in range(120):
        nodes = [("div", [f"A long paragraph that is the own text of page {i}, written once and longer than all boxes."])]
        nodes += rng.sample(boxes, rng.randint(0, 4)) + ([("div", ["A box of few pages only."])] if i in (3, 5, 9) else [])
        rng.shuffle(nodes)
        pages.append((f"http://{rng.choice('abc')}.example/{i}", nodes))
    gone = plain_templates(pages)
    want = {u: "\n\n".join(p for n in nodes if (u.split("/")[2], str(n)) not in gone for p in n[1]) for u, nodes in pages}
    rows = [(u, "".join(f"<{t}>{''.join(f'<p>{p}</p>' for p in ps)}</{t}>" for t, ps in nodes)) for u, nodes in pages]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    assert 0 < len(gone) < 36
    for most in (1_000_000, 0):
        assert {r.url: r.text for r in html_main.extract(df, broadcast_most=most).collect()} == want


def test_the_same_without_stated_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = pages.selectExpr("page_id", "url", "regexp_replace(html, '<(/?)(article|main)\\\\b', '<$1div') AS html")
    assert plain.filter("html LIKE '%<article%'").count() == 0
    assert {r.page_id: r.text for r in html_main.extract(plain).collect()} == {r.page_id: r.text for r in html_main.extract(pages).collect()}


def test_names_learned_on_large_hosts_hold_on_small_ones(spark):
    rows = [(1000 * h + i, f"http://h{h}.example/{i}", f"<div><p>Own text of page {i} at {h}, which is there once.</p></div><div class='rail-{i}'>Read these {i % 3} pages of {h} too.</div>") for h in range(4) for i in range(40)]
    rows += [(9999, "http://small.example/", "<div><p>The only page.</p></div><div class='rail-7'>Never seen elsewhere.</div>")]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9999] == "The only page." and got[1003] == "Own text of page 3 at 1, which is there once."


def text_of(page):
    return html_main.main_text(html_main.parse(page), set())


def test_nothing_else_is_dropped():
    assert text_of("<article>one</article><p>two</p>") == "one\n\ntwo"
    assert text_of("<article><div class='notice-board'>kept</div><p id='menu-of-the-day'>soup</p><p class=adverb>quickly</p></article>") == "kept\n\nsoup\n\nquickly"
    assert text_of("<p title='a hidden nav' data-id=ad data-hidden=1>kept</p>") == "kept"
    assert text_of("<p>a</p><div class='site-footer'>x</div><ul id=comment-list><li>x</ul><div class='ads'>x</div><div class='cookie-banner'>x</div><p hidden>x</p>") == "a"
    assert text_of("a<!-- x -->b<!x>c<?x>d<script>x</script>e<style>x") == "abcde"


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a \"" * 250_000 + ">", "<a '\">" * 170_000, "<div>" * 50_000 + "</p>" * 200_000, "<b>" * 100_000 + "<hr>" * 100_000, "<p><div>" + "<b>" * 50_000 + "<hr>" * 150_000, "<!" * 500_000, "<!-- " * 200_000, "<script " * 100_000, "<li>" * 250_000, "class " * 170_000, "<p " + "a=" * 400_000 + ">x"], ids=range(12))
def test_a_megabyte_of_broken_markup_takes_seconds(page):
    began = time.perf_counter()
    root = html_main.parse(page)
    html_main.main_text(root, html_main.deleted(root, "h", {1}))
    assert time.perf_counter() - began < 8
