"""Boards of single providers: answers of their interfaces, and a job table in HTML."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.plans.views import listings
from harvestry.registry import query
from harvestry.sources.dom import absolute, elements, matching, valued
from harvestry.sources.payloads import TITLE, base, board, board_rows, board_sql, first, joined, sent

AMERICA, FINDLY, PHENOM = "https://careers.bankofamerica.com", "https://jobs.acme.com", "https://careers.acme.com/search"
TEXT = "case when page_id % 9 <> 0 then '{}' || page_id else '' end"


@query(board_sql(TEXT.format(f"{AMERICA}/en-us/job/"), TITLE, location="coalesce(nullif(trim(location), ''), 'HQ')", employment="coalesce(nullif(trim(employment), ''), trim(work_mode))", date="day", department="'Area'"), "listings")
def src_board_rows_boa(spark, d):
    """Addresses are relative to the board's."""
    item = F.struct(F.when(F.col("url").isNotNull(), F.concat(F.lit("/en-us/job/"), F.col("page_id").cast("string"))).alias("jcrURL"), F.col("title").alias("postingTitle"), "location", F.lit("HQ").alias("primaryLocation"), F.col("employment").alias("job_type_text"), F.col("work_mode").alias("workShift"), F.col("day").alias("indexedDate"), F.lit("Area").alias("area"))
    url = F.coalesce(absolute(F.lit(f"{AMERICA}/en-us/job-search"), F.coalesce("x.jcrURL", F.lit(""))), F.lit(""))
    return board_rows(board(sent(base(spark, d)), item, "jobsList"), "jcrURL: string, postingTitle: string, location: string, primaryLocation: string, job_type_text: string, timeType: string, workShift: string, postedDate: string, indexedDate: string, lob: string, area: string, division: string", "jobsList", job_url=url, title=first("x.postingTitle"), location=first("x.location", "x.primaryLocation"), employment=first("x.job_type_text", "x.timeType", "x.workShift"), date=first("x.postedDate", "x.indexedDate"), department=first("x.lob", "x.area", "x.division"))


@query(board_sql(f"case when page_id % 9 <> 0 then url else '{FINDLY}/job/' || page_id || '/' end", TITLE, location="case when nullif(trim(location), '') is null then 'Rome, Bern' else trim(location) || ', IT' end", employment="trim(employment)", date="day", department="'Care'"), "listings")
def src_board_rows_findly(spark, d):
    """A posting without an address gets one from its number; places are a town and a country, else what is said beside them."""
    town = F.nullif(F.trim("location"), F.lit(""))
    item = F.struct(F.col("page_id").alias("id"), "url", "title", town.alias("primary_city"), F.when(town.isNotNull(), "IT").alias("primary_country"), F.array(F.lit("Rome"), F.lit(""), F.lit("Bern")).alias("compliment"), F.col("employment").alias("job_type"), F.col("day").alias("open_date"), F.lit("Care").alias("primary_category"))
    made = F.concat(F.lit(f"{FINDLY}/job/"), F.col("x.id").cast("string"), F.lit("/"))
    return board_rows(board(sent(base(spark, d)), item, None), "id: long, url: string, title: string, primary_city: string, primary_state: string, primary_country: string, compliment: array<string>, employment_type: string, job_type: string, open_date: string, update_date: string, department: string, primary_category: string", None, job_url=first("x.url", made), title=first("x.title"), location=first(joined(F.array("x.primary_city", "x.primary_state", "x.primary_country")), joined(F.col("x.compliment"))), employment=first("x.employment_type", "x.job_type"), date=first("x.open_date", "x.update_date"), department=first("x.department", "x.primary_category"))


@query(board_sql("case when page_id % 9 = 0 then '' when page_id % 2 = 0 then 'https://careers.acme.com/job/' || page_id // 4 else url end", TITLE, location="coalesce(nullif(trim(location), ''), 'Oslo, NO')", employment="trim(employment)", date="day", department="'Ops'").replace("select * from (select", "select * from (select page_id,").replace("where job_url <> '' and title <> ''", "where job_url <> '' and title <> '' qualify row_number() over (partition by job_url order by page_id) = 1"), "listings")
def src_board_rows_phenom(spark, d):
    """A widget's answers, page after page: of postings with one address the first stays."""
    rows = sent(base(spark, d)).withColumn("url", F.when(F.col("url").isNotNull(), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/job/"), F.floor(F.col("page_id") / 4).cast("string"))).otherwise(F.col("url"))))
    item = F.struct(F.col("page_id").alias("id"), F.col("url").alias("externalPath"), F.col("title").alias("positionTitle"), "location", F.lit("Oslo").alias("city"), F.lit("NO").alias("country"), F.col("employment").alias("type"), F.col("day").alias("datePosted"), F.lit("Ops").alias("department"))
    schema = "id: long, applyUrl: string, jobUrl: string, hostedUrl: string, externalPath: string, url: string, title: string, jobTitle: string, positionTitle: string, location: string, city: string, state: string, country: string, type: string, employmentType: string, postedDate: string, datePosted: string, category: string, department: string"
    read = board(rows, item, None).select(F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("x"))
    named = {
        "job_url": F.coalesce(absolute(F.lit(PHENOM), first("x.applyUrl", "x.jobUrl", "x.hostedUrl", "x.externalPath", "x.url")), F.lit("")), "title": first("x.title", "x.jobTitle", "x.positionTitle"), "location": first("x.location", joined(F.array("x.city", "x.state", "x.country"))),
        "employment": first("x.type", "x.employmentType"), "date": first("x.postedDate", "x.datePosted"), "department": first("x.category", "x.department"),
    }
    found = read.select(F.col("x.id").alias("page_id"), *[F.trim(c).alias(n) for n, c in named.items()]).where("job_url <> '' and title <> ''")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("job_url").orderBy("page_id"))).where("nth = 1").drop("nth")


@query("""with r as (select page_id, host, page_id // 5 as board, trim(regexp_replace(replace(title, '<', ' '), '\\s+', ' ', 'g')) as title, coalesce(nullif(trim(s_location), ''), 'Anywhere') as place from listings),
k as (select *, row_number() over (partition by board, page_id // 2 order by page_id) as nth from r where page_id % 6 <> 5)
select board, page_id // 2 as job_id, first(title order by page_id) as title, 'https://jobs.acme.com/job/x-' || board || '/' || page_id // 2 || '/' as job_url, case when min(page_id) % 3 = 0 then '' else arg_min(place, page_id) end as location from k group by board, page_id // 2""", "listings")
def src_board_rows_successfactors(spark, d):
    """Job tables, five postings a page: anchors to postings with a number, the first of each number; the place is the second cell of the row, without the count of further ones."""
    x = listings(spark, d).withColumn("board", F.floor(F.col("page_id") / 5)).withColumn("name", F.regexp_replace(F.replace("title", F.lit("<"), F.lit(" ")), "&", "&amp;"))
    job = F.floor(F.col("page_id") / 2).cast("string")
    place = F.coalesce(F.nullif(F.trim("s_location"), F.lit("")), F.lit("Anywhere"))
    link = F.concat(F.lit('<a href="/job/x-'), F.col("board").cast("string"), F.lit("/"), job, F.when(F.col("page_id") % 6 == 5, "x").otherwise("/"), F.lit('?f=1"> '), "name", F.lit("</a>"))
    row = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<li>"), link, F.lit("</li>"))).otherwise(F.concat(F.lit("<table><tr><td>"), link, F.lit("<td>"), place, F.lit(" + 3 more…</table>")))
    pages = x.groupBy("board").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", row.alias("row")))), lambda r: r["row"]), "").alias("rows")).select(F.col("board").alias("page_id"), F.lit("https://jobs.acme.com/search?startrow=0").alias("url"), F.concat(F.lit("<ul>"), "rows", F.lit("</ul>")).alias("html"))
    nodes = elements(pages)
    links = matching(nodes, 'a[href*="/job/"]')
    found = valued(nodes, links, "innerText").join(links.select("page_id", "node", F.try_element_at("attrs", F.lit("href")).alias("href")), ["page_id", "node"])
    found = found.withColumn("job_id", F.regexp_extract(F.substring_index("href", "?", 1), r"/(\d+)/?$", 1)).withColumn("title", F.trim(F.regexp_replace("value", r"\s+", " "))).where("job_id <> '' and length(title) >= 2")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "job_id").orderBy("node"))).where("nth = 1")
    trs = matching(nodes, "tr").select(F.col("page_id").alias("p"), F.col("node").alias("row"), F.col("last").alias("row_last"))
    within = found.join(trs, (F.col("page_id") == F.col("p")) & F.col("node").between(F.col("row"), F.col("row_last")), "left").groupBy("page_id", "node", "href", "job_id", "title").agg(F.max("row").alias("row"))
    cells = valued(nodes, matching(nodes, "tr > td:nth-of-type(2)"), "innerText").join(nodes.select("page_id", "node", F.col("parent").alias("row")), ["page_id", "node"]).select("page_id", "row", F.trim(F.regexp_replace(F.regexp_replace("value", r"(?i)\+\s*\d+\s*more\s*[.…]*$", ""), r"\s+", " ")).alias("location"))
    rows = within.join(cells, ["page_id", "row"], "left")
    bare = absolute(F.lit("https://jobs.acme.com/search"), F.substring_index("href", "?", 1))
    return rows.select(F.col("page_id").alias("board"), F.col("job_id").cast("long").alias("job_id"), "title", bare.alias("job_url"), F.coalesce("location", F.lit("")).alias("location"))
