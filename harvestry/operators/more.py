"""Counters, logs, scans and further rules of URLs, texts and runs, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.functions.text import collapse
from harvestry.operators.helpers import AGGREGATOR, WALL
from harvestry.operators.records import HOUR, NOW_MS
from harvestry.plans.views import listings, robots, runs, table
from harvestry.registry import query

DAY = 24 * HOUR


@query("""with p as (select robot_id, at_ms // 3600000 as b, max(case when status = 'running' then run_id end) as idle, max(case when status is distinct from 'running' then run_id end) as busy from runs group by 1, 2),
    f as (select robot_id, b, last_value(idle ignore nulls) over w as idle, last_value(busy ignore nulls) over w as busy from p window w as (partition by robot_id order by b)),
    g as (select *, idle - lag(idle) over v as di, busy - lag(busy) over v as db from f where idle is not null window v as (partition by robot_id order by b)),
    h as (select robot_id, b, case when di >= 0 then di else 0 end as di, case when db >= 0 then coalesce(db, 0) else 0 end as db from g where di is not null)
    select robot_id, b * 3600 as t, greatest(0.0, least(100.0, (1.0 - di::double / (di + db)) * 100)) as busy_pct from h where di + db > 0""", "runs")  # fmt: skip
def win_counter_delta(spark, d):
    """Share of busy time from two counters that only grow: the latest sample of each hour, gaps filled, differences of neighbours; a counter set back counts as no advance."""
    sample = lambda on: F.max(F.when(on, F.col("run_id")))
    on = F.coalesce(F.col("status") == "running", F.lit(False))
    p = runs(spark, d).groupBy("robot_id", F.floor(F.col("at_ms") / HOUR).alias("b")).agg(sample(on).alias("idle"), sample(~on).alias("busy"))
    w = Window.partitionBy("robot_id").orderBy("b")
    f = p.select("robot_id", "b", *[F.last(c, True).over(w).alias(c) for c in ("idle", "busy")]).where("idle is not null")
    g = f.select("robot_id", "b", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in ("idle", "busy")]).where("d_idle is not null")
    step = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    g = g.select("robot_id", "b", step("d_idle").alias("di"), step("d_busy").alias("db")).where("di + db > 0")
    return g.select("robot_id", (F.col("b") * 3600).alias("t"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("di") / (F.col("di") + F.col("db"))) * 100)).alias("busy_pct"))


@query("select robot_id, run_id, line from (select robot_id, run_id, coalesce(status, '') || ' ' || run_id as line, row_number() over (partition by robot_id order by at_ms desc, run_id desc) as n from runs) where n <= 20", "runs")
def win_log_tail(spark, d):
    """The limit is the feature: the last 20 lines of each robot's log."""
    n = F.row_number().over(Window.partitionBy("robot_id").orderBy(F.desc("at_ms"), F.desc("run_id")))
    return runs(spark, d).withColumn("n", n).where("n <= 20").select("robot_id", "run_id", F.concat(F.coalesce("status", F.lit("")), F.lit(" "), F.col("run_id").cast("string")).alias("line"))


@query(f"select (n_ms - {NOW_MS}) // 3600000 as hour, count(*) as robots from (select robot_id, max(at_ms) + (cast(floor(({NOW_MS} - max(at_ms)) / ((robot_id % 6 + 1) * 3600000.0)) as bigint) + 1) * (robot_id % 6 + 1) * 3600000 as n_ms from runs group by robot_id) where n_ms between {NOW_MS} and {NOW_MS} + {DAY} group by 1", "runs")
def agg_upcoming(spark, d):
    """Robots that start in each of the next 24 hours: the last run plus whole intervals, rolled forward past now."""
    every = (F.col("robot_id") % 6 + 1) * HOUR
    last = runs(spark, d).groupBy("robot_id").agg(F.max("at_ms").alias("last"))
    due = last.select((F.col("last") + (F.floor((F.lit(NOW_MS) - F.col("last")) / every) + 1) * every).alias("due")).where(F.col("due").between(NOW_MS, NOW_MS + DAY))
    return due.groupBy(F.floor((F.col("due") - NOW_MS) / HOUR).alias("hour")).agg(F.count("*").alias("robots"))


@query("select slot, count(*) as robots, min(robot_id) as first_robot from (select robot_id, max(at_ms) % 86400000 // 900000 as slot from runs group by robot_id) group by slot having count(*) >= 2", "runs")
def agg_schedule_clusters(spark, d):
    """Robots whose daily start falls into the same quarter of an hour."""
    slots = runs(spark, d).groupBy("robot_id").agg(F.floor(F.max("at_ms") % DAY / 900_000).alias("slot"))
    return slots.groupBy("slot").agg(F.count("*").alias("robots"), F.min("robot_id").alias("first_robot")).where("robots >= 2")


@query("select source, count(*) as n, count(*) filter (where status = 'ready') as ready, max(created_ms) as newest_ms from listings group by source", "listings")
def agg_aggregator_overview(spark, d):
    return listings(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ready").alias("ready"), F.max("created_ms").alias("newest_ms"))


@query("select hour, n, row_number() over (order by n desc, hour) as place from (select at_ms // 3600000 % 24 as hour, count(*) as n from runs group by 1)", "runs")
def srt_heatmap(spark, d):
    """Hours of the day, the busiest first; 24 rows at most."""
    hours = runs(spark, d).groupBy((F.floor(F.col("at_ms") / HOUR) % 24).alias("hour")).agg(F.count("*").alias("n"))
    return hours.select("hour", "n", F.row_number().over(Window.orderBy(F.desc("n"), "hour")).alias("place"))


@query("select page_id, title, created_ms from listings where status = 'ready' order by created_ms desc, page_id offset 10 limit 20", "listings")
def src_collection_find(spark, d):
    """The second page of the ready listings, newest first: the limit is the feature."""
    return listings(spark, d).where("status = 'ready'").orderBy(F.desc("created_ms"), "page_id").offset(10).limit(20).select("page_id", "title", "created_ms")


@query("select page_id, status, length(description) < 60 as short, trim(title) <> title as untrimmed from listings", "listings")
def src_cursor_scan(spark, d):
    """One pass over the whole table with what a clean-up asks of each row."""
    return listings(spark, d).select("page_id", "status", (F.length("description") < 60).alias("short"), (F.trim("title") != F.col("title")).alias("untrimmed"))


@query("select page_id, trim(title) as title, list_filter(list_transform(string_split(title, ' '), lambda x: trim(x)), lambda x: x <> '') as words from listings where page_id % 5 <> 0", "listings")
def src_llm_json(spark, d):
    """A model's answer by a fixed schema: texts trimmed, lists without blanks; an answer that is no JSON gives no row."""
    answer = F.when(F.col("page_id") % 5 == 0, "sorry").otherwise(F.to_json(F.struct("title", F.split("title", " ").alias("words"))))
    read = F.from_json("answer", "title string, words array<string>")
    rows = listings(spark, d).select("page_id", answer.alias("answer")).select("page_id", read.alias("j")).where("j.title is not null")
    return rows.select("page_id", F.trim("j.title").alias("title"), F.filter(F.transform("j.words", lambda x: F.trim(x)), lambda x: x != "").alias("words"))


STARTS = "case page_id % 5 when 0 then 'https://https://' || host || '/jobs' when 1 then 'http://user:pw@' || host when 2 then host || '/a' when 3 then 'https:https://' || host || '/b' else url end"


@query(f"select page_id, case when regexp_matches(u, '^https?://[^/?#]*@') then null when regexp_matches(u, '^https?://') then u else 'https://' || u end as start_url from (select page_id, regexp_replace(trim({STARTS}), '^(?:https?:(?://)?)+(https?://)', '\\1') as u from listings)", "listings")
def fn_url_start(spark, d):
    """A robot's start URL: a repeated scheme counts once, a missing one is https, and one with a password is refused."""
    u = F.regexp_replace(F.trim(F.expr(STARTS)), r"^(?:https?:(?://)?)+(https?://)", "$1")
    return listings(spark, d).select("page_id", F.when(u.rlike("^https?://[^/?#]*@"), None).when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u)).alias("start_url"))


HREFS = "case page_id % 4 when 0 then '/jobs/' || page_id || '?x=1' when 1 then 'https://o.com/a?b=c#d' when 2 then '' else '//cdn.com/i.png' end"


@query(f"select page_id, case when h = '' then '' when regexp_matches(h, '^https?://') then split_part(split_part(h, '?', 1), '#', 1) when h like '//%' then regexp_extract(url, '^(https?:)', 1) || split_part(h, '?', 1) else regexp_extract(url, '^(https?://[^/?#]+)', 1) || split_part(h, '?', 1) end as link from (select page_id, url, {HREFS} as h from listings)", "listings")
def fn_url_abs(spark, d):
    """A link made absolute against its page, without its query."""
    h = F.expr(HREFS)
    bare = F.regexp_extract(h, "^([^?#]*)", 1)
    link = F.when(h == "", "").when(h.rlike("^https?://"), bare).when(h.startswith("//"), F.concat(F.regexp_extract("url", "^(https?:)", 1), bare)).otherwise(F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), bare))
    return listings(spark, d).select("page_id", link.alias("link"))


BOARDS = r"(?i)greenhouse\.io|lever\.co|ashbyhq\.com|myworkdayjobs\.com|smartrecruiters\.com|workable\.com|recruitee\.com"
CHOICES = "[case when page_id % 2 = 0 then 'https://hiring.cafe/job/1' else 'https://x.com/apply' end, case when page_id % 3 = 0 then 'https://jobs.lever.co/a/' || page_id else '' end, url]"


@query(f"select page_id, coalesce(list_filter(c, lambda x: regexp_matches(x, '{BOARDS}'))[1], c[1]) as url from (select page_id, list_filter({CHOICES}, lambda x: x <> '' and not regexp_matches(x, '{AGGREGATOR}')) as c from listings)", "listings")
def fn_url_pick(spark, d):
    """A provider's apply URL before the company's own; never the aggregator's."""
    own = F.array(F.when(F.col("page_id") % 2 == 0, "https://hiring.cafe/job/1").otherwise("https://x.com/apply"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://jobs.lever.co/a/"), F.col("page_id").cast("string"))).otherwise(""), F.col("url"))
    c = F.filter(own, lambda x: (x != "") & ~x.rlike(AGGREGATOR))
    return listings(spark, d).select("page_id", F.coalesce(F.get(F.filter(c, lambda x: x.rlike(BOARDS)), F.lit(0)), F.get(c, F.lit(0))).alias("url"))


@query(f"select page_id, html = '' or regexp_matches(left(html, 8000), '{WALL}') as wall from (select page_id, case when page_id % 6 = 0 then '' when page_id % 7 = 0 then 'Attention Required! ' || html else html end as html from pages)")
def fn_bot_wall(spark, d):
    html = F.when(F.col("page_id") % 6 == 0, "").when(F.col("page_id") % 7 == 0, F.concat(F.lit("Attention Required! "), "html")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", ((html == "") | F.substring(html, 1, 8000).rlike(WALL)).alias("wall"))


@query("select doc_id, octet_length(encode(coalesce(text, ''))) as n_bytes, least(octet_length(encode(coalesce(text, ''))), 1000) as kept from documents")
def fn_text_trunc(spark, d):
    """Texts cut at a number of bytes: the limit is the feature."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return table(spark, d, "documents").select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), F.octet_length(F.substring(data, 1, 1000)).cast("long").alias("kept"))


@query("select page_id, s as search from (select page_id, case when page_id % 3 = 0 then ['dev ' || page_id, 'Berlin'] when page_id % 3 = 1 then ['Berlin'] else [] end as s from listings)", "listings")
def fn_search_state(spark, d):
    """The search that a URL's parameter holds as JSON: its first chips, five at most."""
    state = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("dev "), F.col("page_id").cast("string")).alias("q"), F.lit("Berlin").alias("place")))).when(F.col("page_id") % 3 == 1, F.to_json(F.struct(F.lit("Berlin").alias("place")))).otherwise("{broken")
    url = F.concat(F.lit("https://x.com/?a=1&searchState="), F.url_encode(state))
    rows = listings(spark, d).select("page_id", F.from_json(F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit("searchState"))), "q string, place string").alias("j"))
    return rows.select("page_id", F.slice(F.array_compact(F.array("j.q", "j.place")), 1, 5).alias("search"))


@query("select page_id, concat_ws(chr(10) || chr(10), 'About' || chr(10) || title, case when employment <> '' then 'Skills' || chr(10) || '• ' || employment || chr(10) || '• ' || work_mode end) as text from listings", "listings")
def fn_compose_desc(spark, d):
    """Sections put together under headings; empty ones are left out."""
    skills = F.when(F.col("employment") != "", F.concat(F.lit("Skills\n"), F.array_join(F.transform(F.array("employment", "work_mode"), lambda x: F.concat(F.lit("• "), x)), "\n")))
    return listings(spark, d).select("page_id", F.concat_ws("\n\n", F.concat(F.lit("About\n"), "title"), skills).alias("text"))


@query("select run_id, case run_id % 5 when 0 then '' when 1 then 'Yes' when 2 then 'a, b' when 3 then rows_extracted::varchar else status end as cell from runs", "runs")
def fn_cell_display(spark, d):
    """A typed cell as text: nothing is blank, truth is Yes or No, lists are joined."""
    k = F.col("run_id") % 5
    return runs(spark, d).select("run_id", F.when(k == 0, "").when(k == 1, F.when(F.lit(True), "Yes").otherwise("No")).when(k == 2, F.array_join(F.array(F.lit("a"), F.lit("b")), ", ")).when(k == 3, F.col("rows_extracted").cast("string")).otherwise(F.col("status")).alias("cell"))


@query("select run_id, strftime(make_timestamp(at_ms // 60000 * 60000000), '%Y-%m-%dT%H:%M:%SZ') as finished_at from runs", "runs")
def hp_repair_finished(spark, d):
    """Local finish times, month first or, where that can't be, day first, rewritten in one form."""
    stamp = F.timestamp_millis("at_ms")
    day_first = (F.col("run_id") % 2 == 0) & (F.dayofmonth(stamp) > 12)
    text = F.when(day_first, F.date_format(stamp, "d/M/yyyy, h:mm a")).otherwise(F.date_format(stamp, "M/d/yyyy, h:mm a"))
    rows = runs(spark, d).select("run_id", text.alias("f"))
    read = F.coalesce(*[F.try_to_timestamp("f", F.lit(x)) for x in ("M/d/yyyy, h:mm a", "d/M/yyyy, h:mm a")])
    return rows.select("run_id", F.date_format(read, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at"))


@query("select robot_id, count(*) filter (where rows_extracted > 0 and status <> 'failed') > 0 as expected from runs group by robot_id", "runs")
def hp_output_expected(spark, d):
    """Whether any row of a robot that is no error has the field asked for."""
    return runs(spark, d).groupBy("robot_id").agg(F.coalesce(F.bool_or((F.col("rows_extracted") > 0) & (F.col("status") != "failed")), F.lit(False)).alias("expected"))


@query("select robot_id, run_id, n from (select robot_id, run_id, row_number() over (partition by robot_id order by at_ms, run_id) as n from runs) where n between 6 and 10", "runs")
def hp_legacy_rows(spark, d):
    """The second page of five of each robot's embedded rows."""
    n = F.row_number().over(Window.partitionBy("robot_id").orderBy("at_ms", "run_id"))
    return runs(spark, d).select("robot_id", "run_id", n.alias("n")).where("n between 6 and 10")


@query(f"select robot_id, last_ms as last_run_ms, last_ms + (robot_id % 6 + 1) * {HOUR} as next_run_ms from (select robot_id, max(at_ms) as last_ms from runs group by robot_id)", "runs")
def hp_schedule_advance(spark, d):
    """Last and next start after a schedule has fired."""
    last = runs(spark, d).groupBy("robot_id").agg(F.max("at_ms").alias("last_run_ms"))
    return last.withColumn("next_run_ms", F.col("last_run_ms") + (F.col("robot_id") % 6 + 1) * HOUR)


@query("select page_id, coalesce(nullif(company, ''), s_company, '') as company, coalesce(nullif(trim(location), ''), s_location, '') as location, coalesce(nullif(category, ''), s_category, source, '') as category from listings", "listings")
def hp_card_enrich(spark, d):
    """Card fields that are blank, filled from the snapshot and then the source."""
    own = lambda c, *more: F.coalesce(F.nullif(F.trim(c), F.lit("")), f"s_{c}", *more, F.lit("")).alias(c)
    return listings(spark, d).select("page_id", own("company"), own("location"), own("category", F.col("source")))


@query("select robot_id, run_id, '{\"id\":' || run_id || ',\"status\":\"' || coalesce(status, 'idle') || '\",\"rows\":' || coalesce(rows_extracted, 0) || '}' as json from runs", "runs")
def prj_run_api(spark, d):
    """A run as the public interface gives it."""
    body = F.struct(F.col("run_id").alias("id"), F.coalesce("status", F.lit("idle")).alias("status"), F.coalesce("rows_extracted", F.lit(0)).alias("rows"))
    return runs(spark, d).select("robot_id", "run_id", F.to_json(body).alias("json"))


@query("select page_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title, coalesce(s_company, '') as company, length(trim(regexp_replace(description, '\\s+', ' ', 'g'))) as n_description from listings", "listings")
def prj_list_snapshot(spark, d):
    """What is stored of a listing when a list is read: a nested record of cleaned fields."""
    snapshot = F.struct(collapse(F.col("title")).alias("title"), F.coalesce("s_company", F.lit("")).alias("company"), collapse(F.col("description")).alias("description"))
    return listings(spark, d).select("page_id", snapshot.alias("s")).select("page_id", "s.title", "s.company", F.length("s.description").alias("n_description"))


@query("select owner, count(*) as robots, count(*) filter (where name is null) as unnamed from robots group by owner", "robots")
def hp_reconfigure_robots(spark, d):
    """Robots of each owner that a planner gets."""
    return robots(spark, d).groupBy("owner").agg(F.count("*").alias("robots"), F.count_if(F.col("name").isNull()).alias("unnamed"))
