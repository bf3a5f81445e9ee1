"""A breadth-first crawl over extracted links, one crawl for each site, round by round.

A round's frontier meets the links of its pages; what was seen before goes by an anti-join, and the new URLs
take their places in the order in which a queue would have them: by the place of the page that names them first,
then by the link's place on it. Each round is written to the shared folder, so that no round repeats the
ones before; the crawl ends when a round finds nothing, at its depth, or with its `limit` of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.plans.views import table
from harvestry.registry import query
from harvestry.sources.dom import absolute
from harvestry.sources.storage import fresh_path

#: Pages of a crawl and how far it goes from its start, unless told otherwise.
LIMIT, DEPTH = 12, 3
HREF = r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"']"


def bare(url: Column) -> Column:
    """What two URLs of one page have alike: no fragment, no last slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")


def links_of(pages: DataFrame) -> DataFrame:
    """source (bare URL), place, link: the http links of each page in the order of their anchors."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("place", "href"))
    return rows.select(bare(F.col("url")).alias("source"), "place", absolute(F.col("url"), F.replace("href", F.lit("&amp;"), F.lit("&"))).alias("link")).where("link rlike '^https?://'")


def kept(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crawl(pages: DataFrame, starts: DataFrame, allowed: Column, depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """crawl, url, depth, place, found: what each crawl visits, in its order.

    pages: url, html; starts: crawl, url; allowed: a predicate over `crawl` and `link`. A URL that no page answers is visited and
    not found: it counts towards the limit and has no links. Pages that share a URL answer as one, the first by html.
    """
    own = kept(pages.groupBy(bare(F.col("url")).alias("key")).agg(F.min("html").alias("html"), F.min("url").alias("url")), "crawl-pages")
    links = kept(links_of(own), "crawl-links")
    keys = own.select("key", F.lit(True).alias("hit"))
    frontier = starts.select("crawl", "url", bare(F.col("url")).alias("key"), F.lit(0).alias("depth"), F.lit(1).alias("place"))
    frontier = kept(frontier.join(keys, "key", "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit"), "crawl-round")
    rounds = seen = frontier
    for d in range(1, depth + 1):
        parents = frontier.where("found").select("crawl", F.col("key").alias("source"), F.col("place").alias("parent"))
        new = links.join(parents, "source").where(allowed).withColumn("key", bare(F.col("link")))
        new = new.groupBy("crawl", "key").agg(F.min(F.struct("parent", "place", "link")).alias("x"))
        new = new.join(seen.select("crawl", "key"), ["crawl", "key"], "left_anti")
        visited = seen.groupBy("crawl").agg(F.max("place").alias("visited"))
        placed = new.withColumn("n", F.row_number().over(Window.partitionBy("crawl").orderBy("x.parent", "x.place"))).where(F.col("n") <= limit)
        placed = placed.join(visited, "crawl").withColumn("place", F.col("visited") + F.col("n")).where(F.col("place") <= limit)
        placed = placed.join(keys, "key", "left")
        frontier = kept(placed.select("crawl", F.col("x.link").alias("url"), "key", F.lit(d).alias("depth"), F.col("place").cast("int").alias("place"), F.coalesce("hit", F.lit(False)).alias("found")), "crawl-round")
        if frontier.isEmpty():
            break
        rounds = seen = seen.unionByName(frontier)
    return rounds.select("crawl", "url", "depth", "place", "found")


def _rounds() -> str:
    """The crawl's rounds written out, one after the other."""
    norm = lambda c: f"regexp_replace(regexp_replace({c}, '#.*$', ''), '/$', '')"
    sql = f"""own as (select {norm('url')} as key, min(html) as html, min(url) as url from pages group by 1),
hrefs as (select key as source, url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href=["'']([^"'']+)["'']', 1)) as href, unnest(range(len(regexp_extract_all(html, '(?i)<a\\b[^>]*href=["'']([^"'']+)["'']', 1)))) as place from own),
links as (select source, place, regexp_extract(url, '^(https?://[^/?#]+)', 1) || replace(href, '&amp;', '&') as link from hrefs where href like '/%' and href not like '//%'),
starts as (select regexp_extract(url, '^https?://([^/?#]+)', 1) as crawl, min_by(url, page_id) as url from pages group by 1),
r0 as (select crawl, url, {norm('url')} as key, 0 as depth, 1 as place, {norm('url')} in (select key from own) as found from starts)"""
    for d in range(1, DEPTH + 1):
        before = " union all ".join(f"select crawl, key, place from r{k}" for k in range(d))
        sql += f""",
n{d} as (select p.crawl, {norm('l.link')} as key, min((p.place, l.place, l.link)) as x from r{d - 1} p join links l on l.source = p.key where p.found and regexp_extract(l.link, '^https?://([^/?#]+)', 1) = p.crawl and l.link not like '%/de%' group by all),
s{d} as ({before}),
r{d} as (select n.crawl, x[3] as url, n.key, {d} as depth, v.visited + row_number() over (partition by n.crawl order by x[1], x[2]) as place, n.key in (select key from own) as found
  from n{d} n join (select crawl, max(place) as visited from s{d} group by crawl) v on v.crawl = n.crawl where not exists (select 1 from s{d} s where s.crawl = n.crawl and s.key = n.key) qualify place <= {LIMIT})"""
    return f"with {sql} select crawl, url, depth, place, found from (" + " union all ".join(f"select * from r{d}" for d in range(DEPTH + 1)) + ")"


@query(_rounds())
def crawl_bfs(spark, d):
    """A crawl of every site from its first page: links within the site, but those that an excluded pattern names."""
    pages = table(spark, d, "pages")
    site = lambda c: F.regexp_extract(c, "^https?://([^/?#]+)", 1)
    starts = pages.groupBy(site("url").alias("crawl")).agg(F.min_by("url", "page_id").alias("url"))
    return crawl(pages, starts, (site("link") == F.col("crawl")) & ~F.col("link").contains("/de"))
