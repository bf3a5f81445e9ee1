"""Queries that scrape pages by selectors, find their lists, and fold captures into rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.functions.text import entities_sql
from harvestry.plans.views import table
from harvestry.registry import query
from harvestry.sources.dom import discover_lists, elements, scrape_auto, scrape_list_auto, scrape_schema
from harvestry.sources.pages import ITEMS

#: Paragraphs and headings of the pages' articles, as SQL reads them: a paragraph ends where the next one begins.
_bare = lambda c: f"trim(regexp_replace({entities_sql(f'regexp_replace(regexp_replace({c}, chr(60) || chr(98) || chr(114) || chr(62), chr(10), chr(103)), chr(60) || $x$[^>]+>$x$, $x$$x$, $x$g$x$)')}, '\\s+', ' ', 'g'))"
ARTICLES = f"""article as (select page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as body from pages),
parts as (select page_id, unnest(string_split(body, '<p>')[2:]) as p, unnest(range(len(string_split(body, '<p>')) - 1)) as position, regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1) as h from article),
paragraphs as (select page_id, position, {_bare('p')} as text, {_bare('h')} as heading from parts)"""
MENU = {"name": ("nav a", "innerText"), "link": ("nav li a[href]", "href")}
TEXT = {"name": ("article > h1", "innerText"), "link": ("article p", "textContent")}


@query(f"""with {ITEMS}, {ARTICLES}
select 'menu' as form, page_id, position::int as position, {entities_sql('name')} as name, regexp_extract(url, '^(https?://[^/?#]+)', 1) || {entities_sql('link')} as link from i join (select page_id, url from pages) using (page_id)
union all select 'text', page_id, position, case when position = 0 then heading end, text from paragraphs""")
def html_scrape_schema(spark, d):
    """Two schemas over all pages: links of menus, whose records are the elements around each; headings and paragraphs, which have no element around each pair and go by number."""
    pages = table(spark, d, "pages")
    nodes = elements(pages)
    menu, text = (scrape_schema(pages, fields, nodes).withColumn("form", F.lit(form)) for form, fields in (("menu", MENU), ("text", TEXT)))
    return menu.unionByName(text)


@query(f"with {ITEMS} select page_id, 0 as position, 'record_' || lpad(position::varchar, 4, '0') as key, {entities_sql('name')} as value from i")
def html_scrape_auto(spark, d):
    """The lines of each menu."""
    return scrape_auto(table(spark, d, "pages"), "nav ul")


@query(f"with {ITEMS} select page_id, position::int as position, 'html > body > nav > ul > li' as selector, {entities_sql('name')} as text from i")
def html_scrape_list_auto(spark, d):
    return scrape_list_auto(table(spark, d, "pages"), "nav ul")


@query(f"""with {ITEMS}, {ARTICLES}, groups as (
  select page_id, 0 as place, 'ul' as parent_tag, 'li' as tag, count(*) as n, arg_min({entities_sql('name')}, position) as line from i group by page_id
  union all select page_id, 1, 'article', 'p', count(*), arg_min(text, position) from paragraphs group by page_id)
select page_id, row_number() over (partition by page_id order by n desc, place) as rank, parent_tag, tag, n, n * 10 as score, tag as selector, case when length(line) > 120 then line[:120] || '...' else line end as preview from groups where n >= 3""")
def html_discover_lists(spark, d):
    return discover_lists(table(spark, d, "pages"))


@query("""with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, event_type as k, value from events),
w as (select user_id, i, 0 as row, [k] as seen from e where i = 1
  union all select e.user_id, e.i, case when list_contains(w.seen, e.k) then w.row + 1 else w.row end, case when list_contains(w.seen, e.k) then [e.k] else list_append(w.seen, e.k) end from w join e on e.user_id = w.user_id and e.i = w.i + 1)
select user_id, row, max(value) filter (k = 'click') as click, max(value) filter (k = 'error') as error, max(value) filter (k = 'purchase') as purchase, max(value) filter (k = 'signup') as signup, max(value) filter (k = 'view') as view
from w join e using (user_id, i) group by user_id, row""")
def html_scrape_schema_merge(spark, d):
    """Captures of one session folded into rows: a capture of new keys joins the last row, one that repeats a key of it begins another.

    Every event is a capture of one key. A row that begins at a capture ends before the first one whose key came since; how far
    that is from each capture follows from windows, and only the walk from row to row is a fold, over one session's captures.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("k"), "value").withColumn("i", F.row_number().over(order))
    again = F.lead("i").over(Window.partitionBy("user_id", "k").orderBy("ts", "event_id"))
    rows = rows.withColumn("again", again)
    # The first repetition at or after a capture: a running minimum from the session's end.
    back = Window.partitionBy("user_id").orderBy(F.desc("i"))
    rows = rows.withColumn("next", F.min("again").over(back))
    jumps = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "next"))).alias("way"))
    starts = F.aggregate("way", F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, x: F.when(x["i"] == s["at"], F.struct(F.coalesce(x["next"], F.lit(0)).alias("at"), F.array_append(s["starts"], x["i"]).alias("starts"))).otherwise(s))
    begin = jumps.select("user_id", F.posexplode(starts["starts"]).alias("row", "first"))
    ranges = begin.withColumn("end", F.lead("first", 1, 1 << 30).over(Window.partitionBy("user_id").orderBy("first")))
    found = rows.join(ranges.withColumnRenamed("user_id", "u"), (F.col("user_id") == F.col("u")) & (F.col("i") >= F.col("first")) & (F.col("i") < F.col("end")))
    return found.groupBy("user_id", "row").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(k) for k in ("click", "error", "purchase", "signup", "view")])
