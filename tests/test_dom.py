"""The table of elements, selectors and scrapers on hand-worked pages; the crawl on a small site against a plain queue."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from harvestry.sources import crawl as crawling
from harvestry.sources import dom
from harvestry.sources.markdown import Writer

PAGE = """<!doctype html><html><head><title>T &amp; U</title><script>var a = "<p>no</p>"</script></head><body>
<div id="main" class="box wide"><h2>One<br>two</h2>
<ul class="jobs"><li class="job open"><a href="/a?x=1" data-k="v">First <b>job</b></a><img src="i.png"><span>Paris</span>
<li class="job"><a href="b">Second</a><img srcset="s.png 1x, l.png 2x"><li class="job"><a>Third</a><img src="data:x"></ul>
<table><tr><th>Name<th></tr><tr><td>n1<td>v1 <table><tr><td>in<td>ner</tr><tr><td>a<td>b</table></tr></table>
<p>para <i>one<p>para two</div></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://s.org/d/p?q", PAGE), (2, "https://s.org/", None), (3, "https://s.org/e", "")], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return dom.elements(pages).cache()


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("li a", ["First job", "Second", "Third"]),
        ("#main > ul.jobs > li.job:nth-child(2) a", ["Second"]),
        ("li.open span, li:last-child > a", ["Paris", "Third"]),
        ("a[href^='/a'][data-k=v]", ["First job"]),
        ("li:not(.open) a[href]", ["Second"]),
        ("a + img ~ span", ["Paris"]),
        ("body h2", ["One\ntwo"]),
        ("title", ["T & U"]),
        ("table table td:first-child", ["in", "a"]),
        ("div > p", ["para one", "para two"]),
        ("li[CLASS~='OPEN' i] span", ["Paris"]),
        ("em", []),
    ],
)
def test_selectors(nodes, selector, texts):
    got = dom.valued(nodes, dom.matching(nodes, selector), "innerText").orderBy("page_id", "node").collect()
    assert [r.value for r in got] == texts


def test_selector_that_is_not_understood(nodes):
    with pytest.raises(ValueError, match="not understood"):
        dom.matching(nodes, "a::before")


def test_records_by_bounding_element(pages, nodes):
    fields = {"name": ("li a", "innerText"), "image": ("li img", "src"), "link": ("li > a", "href")}
    got = dom.scrape_schema(pages, fields, nodes).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, 0, "First job", "https://s.org/d/i.png", "https://s.org/a?x=1"), (1, 1, "Second", None, "https://s.org/d/b"), (1, 2, "Third", "data:x", None)]


def test_records_by_number_where_one_lacks_a_field(pages, nodes):
    got = dom.scrape_schema(pages, {"name": ("li a", "innerText"), "place": ("li span", "innerText"), "top": ("h2", "innerText")}, nodes).orderBy("position").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "First job", "Paris", "One\ntwo"), (1, "Second", None, None), (2, "Third", None, None)]


def test_images_and_lines(pages, nodes):
    got = {(r.position, r.key): r.value for r in dom.scrape_auto(pages, "li", nodes).collect()}
    assert got == {(0, "record_0000"): "First jobParis", (0, "img_0"): "https://s.org/d/i.png", (1, "record_0000"): "Second", (1, "img_0"): "l.png", (2, "record_0000"): "Third"}


def test_ways_to_children(pages, nodes):
    got = dom.scrape_list_auto(pages, "ul", nodes).orderBy("position").collect()
    assert [(r.selector, r.text) for r in got][:2] == [("div#main > ul.jobs > li.job.open", "First jobParis"), ("div#main > ul.jobs > li.job", "Second")]


def test_lists_found(pages, nodes):
    got = dom.discover_lists(pages, nodes=nodes).collect()
    assert [(r.rank, r.parent_tag, r.tag, r.n, r.score, r.selector, r.preview) for r in got] == [(1, "ul", "li", 3, 40, "li.job", "First jobParis")]


def test_nested_tables(pages, nodes):
    got = sorted(tuple(r) for r in dom.detect_tables(pages, nodes).collect())
    assert got == [(1, 0, 0, ["Name", "Column 2"], ["n1", "v1\nin ner\na b"]), (1, 1, 0, ["in", "ner"], ["a", "b"])]


def test_ranked_selectors(pages, nodes):
    got = dom.scrape_ranked(pages, "li", {"place": ["em", "span", "value@nowhere"], "key": ["a@data-k"]}, nodes, limit=2).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Paris", "v", 1, 0), (1, 1, "nowhere", "", 2, None)]


def test_links_against_a_page(spark):
    asked = ["/x", "y", "?z=1", "#f", "//h/i", "mailto:a@b", "http://o/p", " "]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(asked)], "i int, h string").select("i", dom.absolute(F.lit("https://s.org/d/p?q"), F.col("h")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == ["https://s.org/x", "https://s.org/d/y", "https://s.org/d/p?z=1", "https://s.org/d/p?q#f", "https://h/i", "mailto:a@b", "http://o/p", None]


@pytest.mark.parametrize("limit", [5, 100])
def test_crawl_against_a_queue(spark, limit):
    rng = random.Random(limit)
    graph = {k: [rng.randrange(60) for _ in range(rng.randrange(5))] for k in range(40)}  # pages from 40 on do not exist
    rows = [(f"http://a.org/{k}", "".join(f'<a href="/{x}{"#f" if x % 3 == 0 else ""}">l</a>' for x in links)) for k, links in graph.items()]
    starts = [0, 1, 7, 59]
    got = crawling.crawl(spark.createDataFrame(rows, "url string, html string"), spark.createDataFrame([(f"c{s}", f"http://a.org/{s}") for s in starts], "crawl string, url string"), ~F.col("link").endswith("/13"), depth=4, limit=limit)
    want = []
    for s in starts:
        seen, queue, n = {s}, deque([(s, 0)]), 0
        while queue and n < limit:
            k, depth = queue.popleft()
            n += 1
            want.append((f"c{s}", k, depth, n, k in graph))
            for x in graph.get(k, []) if depth < 4 else []:
                if x not in seen and x != 13:
                    seen.add(x)
                    queue.append((x, depth + 1))
    assert sorted((r.crawl, int(r.url.split("/")[-1].split("#")[0]), r.depth, r.place, r.found) for r in got.collect()) == sorted(want)


def test_cells_keep_their_blanks_and_bare_references(spark):
    html = "<table><tr><th>a</th><th> </th></tr><tr><td> x =  y </td><td>1 &amp;&amp</td></tr></table>"
    row = dom.detect_tables(spark.createDataFrame([(1, "https://x.org", html)], "page_id long, url string, html string")).first()
    assert (row.headers, row.cells) == (["a", "Column 2"], ["x =  y", "1 &&amp"])
    assert Writer("<h1>and&amp;&amp</h1><a href='/?a=1&amp;b=2&copy'>z&lt;</a>", "https://x.org").markdown() == "# and&&amp\n\n[z<](https://x.org/?a=1&b=2&copy)"
