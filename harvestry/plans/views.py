"""The logical tables of scheduled data collection, derived from the driver's tables: as DataFrames and as SQL.

runs come from events, robots from customers and nations, listings from pages, documents and labels.
Times are milliseconds since 1970 (`at_ms`), so that no session time zone takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Error texts of failed runs, by event_id modulo 8: one for each reason, one that fits none, one blank.
ERRORS = ("hCaptcha challenge shown", "Target page, context or browser has been closed", "Host circuit open for 300 s", "Navigation timeout of 30000 ms", "page.goto: net::ERR_CONNECTION_RESET", "Selector .job-card matched nothing", "Unexpected token in response", "   ")
METHODS = ("ats", "scrape.do", "browser", "list", "llm", "none")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows shuffled by a key over all cores, for work that takes long for each: a small file is one task, however many cores there are."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def at_ms(column: str) -> F.Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, robot_id, status, at_ms, rows_extracted, jobs_added, duration_ms, started_ms, finished_at (text, sometimes a local form), error_message."""
    e = table(spark, sf_dir, "events").withColumn("at_ms", at_ms("ts"))
    status = F.expr("case event_type when 'error' then 'failed' when 'click' then 'aborted' when 'purchase' then 'success' when 'signup' then 'completed' when 'view' then 'running' end")
    kind = F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("event_id") % 8 + 1).cast("int"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    local = F.date_format("ts", "M/d/yyyy, h:mm a")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("robot_id"), status.alias("status"), "at_ms",
        F.floor("value").cast("long").alias("rows_extracted"), F.floor(F.col("value") / 10).cast("long").alias("jobs_added"),
        F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") * 1000).cast("long")).alias("duration_ms"),
        (F.col("at_ms") - F.col("event_id") % 97 * 1000).alias("started_ms"),
        F.when(status == "running", None).when(F.col("event_id") % 11 == 0, local).otherwise(iso).alias("finished_at"),
        F.when(status == "failed", kind).alias("error_message"),
        F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") >= 3), F.col("event_id") - 3).alias("retry_of"),
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robot_id, name, company, owner, tags: every robot that ran."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("robot_id")).distinct()
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("robot_id"), "c_name", "c_mktsegment", "c_nationkey")
    n = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 rows by the schema
    return ids.join(c, "robot_id", "left").join(n, "c_nationkey", "left").select(
        "robot_id", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company"), F.col("c_nationkey").cast("long").alias("owner"),
        F.array(F.concat(F.lit("segment:"), "c_mktsegment"), F.concat(F.lit("nation:"), "n_name")).alias("tags"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page; the row's own company, location and category are blank for every third page, where only the snapshot has them."""
    p = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).withColumn("title", F.regexp_extract("html", r"<title>([^<]*)</title>", 1))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", "source", "lang")
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), "quality")
    n = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nk"), F.col("n_name").alias("s_location")))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_type").alias("s_category"))
    x = p.select("page_id", "url", "host", "title").join(d, "page_id", "left").join(q, "page_id", "left").join(t, "page_id", "left").join(n, F.col("page_id") % 25 == F.col("nk"), "left")
    own = F.col("page_id") % 3 != 0
    x = x.withColumn("s_company", F.element_at(F.split(F.regexp_replace("host", r"^(www|m)\.", ""), r"\."), 1))
    blank = lambda c: F.when(own, F.col(c)).otherwise(F.lit("")).alias(c[2:])
    return x.select(
        "page_id", "url", "host", "title", F.coalesce("text", F.lit("")).alias("description"), "source", "lang",
        F.expr("case quality when 1 then 'ready' when 0 then 'partial' else 'queued' end").alias("status"),
        F.element_at(F.array(*map(F.lit, METHODS)), (F.col("page_id") % 6 + 1).cast("int")).alias("method"),
        (F.lit(1704067200000) + F.col("page_id") * 3600000).alias("created_ms"),
        F.expr("case page_id % 4 when 0 then 'Full-time' when 1 then 'part time' when 2 then 'Contract' else '' end").alias("employment"),
        F.expr("case page_id % 3 when 0 then 'Remote' when 1 then 'On-site' else 'hybrid' end").alias("work_mode"),
        blank("s_company"), blank("s_location"), blank("s_category"), "s_company", "s_location", "s_category",
    )


_errors = "case event_id % 8 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(ERRORS)) + " end"
_methods = "case page_id % 6 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(METHODS)) + " end"
VIEW_SQL = {
    "runs": f"""select event_id as run_id, user_id as robot_id, status, at_ms, cast(floor(value) as bigint) as rows_extracted, cast(floor(value / 10) as bigint) as jobs_added,
        case when event_id % 7 <> 0 then cast(round(value * 1000) as bigint) end as duration_ms, at_ms - event_id % 97 * 1000 as started_ms,
        case when status = 'running' then null when event_id % 11 = 0 then strftime(ts, '%-m/%-d/%Y, %-I:%M %p') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' end as finished_at,
        case when status = 'failed' then {_errors} end as error_message, case when event_id % 5 = 0 and event_id >= 3 then event_id - 3 end as retry_of
        from (select *, epoch_us(ts) // 1000 as at_ms, case event_type when 'error' then 'failed' when 'click' then 'aborted' when 'purchase' then 'success' when 'signup' then 'completed' when 'view' then 'running' end as status from events)""",
    "robots": """select robot_id, c_name as name, c_mktsegment as company, cast(c_nationkey as bigint) as owner, ['segment:' || c_mktsegment, 'nation:' || n_name] as tags
        from (select distinct user_id as robot_id from events) left join customer on c_custkey = robot_id left join nation on n_nationkey = c_nationkey""",
    "listings": f"""select page_id, url, host, title, coalesce(text, '') as description, source, lang,
        case quality when 1 then 'ready' when 0 then 'partial' else 'queued' end as status, {_methods} as method, 1704067200000 + page_id * 3600000 as created_ms,
        case page_id % 4 when 0 then 'Full-time' when 1 then 'part time' when 2 then 'Contract' else '' end as employment,
        case page_id % 3 when 0 then 'Remote' when 1 then 'On-site' else 'hybrid' end as work_mode,
        case when page_id % 3 <> 0 then s_company else '' end as company, case when page_id % 3 <> 0 then s_location else '' end as location, case when page_id % 3 <> 0 then s_category else '' end as category,
        s_company, s_location, s_category
        from (select p.*, d.text, d.source, d.lang, l.quality, n_name as s_location, p_type as s_category, string_split(regexp_replace(host, '^(www|m)\\.', ''), '.')[1] as s_company
              from (select *, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages) p
              left join documents d on d.doc_id = page_id left join labels l on l.doc_id = page_id left join part on p_partkey = page_id left join nation on n_nationkey = page_id % 25)""",
}
