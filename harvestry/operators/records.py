"""Schedules, record fields, tags and key sets: small native expressions, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions.text import nz
from harvestry.plans.views import listings, robots, runs, table
from harvestry.registry import query

HOUR = 3_600_000
NOW_MS = 1705000000000
#: Schedule presets, their interval in ms, and its name.
PRESETS = (
    ("*/15 * * * *", 900_000, "15 minutes"),
    ("*/30 * * * *", 1_800_000, "30 minutes"),
    ("0 * * * *", HOUR, "1 hour"),
    ("0 */6 * * *", 6 * HOUR, "6 hours"),
    ("0 */12 * * *", 12 * HOUR, "12 hours"),
    ("0 0 * * *", 24 * HOUR, "1 day"),
    ("0 0 */2 * *", 48 * HOUR, "2 days"),
    ("0 0 */3 * *", 72 * HOUR, "3 days"),
    ("0 0 * * 1", 168 * HOUR, "1 week"),
    ("0 0 1 * *", 720 * HOUR, "30 days"),
)
#: The presets, then a free form and a blank one.
CRONS = tuple(c.replace(" ", "  ", 1) for c, _, _ in PRESETS) + ("30 9 * * 1-5", " ")
_every = " ".join(f"when '{c}' then {ms}" for c, ms, _ in PRESETS)
_label = " ".join(f"when {ms} then '{label}'" for _, ms, label in PRESETS)
_crons = "[" + ", ".join(f"'{c}'" for c in CRONS) + "]"
#: A robot's schedule: its last run, the next one where it is known, and its interval.
PLAN = f"""plan as (select *, case regexp_replace(trim(cron), '\\s+', ' ', 'g') {_every} end as every_ms from (select robot_id, max(at_ms) as last_ms,
    case when robot_id % 3 <> 0 then max(at_ms) + (robot_id % 5 - 2) * {HOUR} end as next_ms, {_crons}[robot_id % {len(CRONS)} + 1] as cron from runs group by robot_id))"""


def plans(spark, d) -> DataFrame:
    last = runs(spark, d).groupBy("robot_id").agg(F.max("at_ms").alias("last_ms"))
    cron = F.element_at(F.array(*map(F.lit, CRONS)), (F.col("robot_id") % len(CRONS) + 1).cast("int"))
    rows = last.withColumn("next_ms", F.when(F.col("robot_id") % 3 != 0, F.col("last_ms") + (F.col("robot_id") % 5 - 2) * HOUR)).withColumn("cron", cron)
    clean, every = F.regexp_replace(F.trim("cron"), r"\s+", " "), F.lit(None).cast("long")
    for c, ms, _ in PRESETS:
        every = F.when(clean == c, F.lit(ms).cast("long")).otherwise(every)
    return rows.withColumn("every_ms", every)


@query(f"with {PLAN} select robot_id, every_ms from plan", "runs")
def dt_cron_interval(spark, d):
    return plans(spark, d).select("robot_id", "every_ms")


@query(f"with {PLAN} select robot_id, case every_ms {_label} end as label from plan", "runs")
def hp_interval_label(spark, d):
    label = F.lit(None).cast("string")
    for _, ms, name in PRESETS:
        label = F.when(F.col("every_ms") == ms, name).otherwise(label)
    return plans(spark, d).select("robot_id", label.alias("label"))


@query(f"with {PLAN} select robot_id from plan where nullif(trim(cron), '') is null", "runs")
def flt_schedule_cron(spark, d):
    """Robots without a schedule."""
    return plans(spark, d).where(nz(F.col("cron")).isNull()).select("robot_id")


@query(f"with {PLAN} select robot_id, coalesce({NOW_MS} >= coalesce(last_ms + every_ms, next_ms) + 600000, false) as overdue from plan", "runs")
def dt_overdue(spark, d):
    due = F.coalesce(F.col("last_ms") + F.col("every_ms"), F.col("next_ms"))
    return plans(spark, d).select("robot_id", F.coalesce(F.lit(NOW_MS) >= due + 600_000, F.lit(False)).alias("overdue"))


FIRST = f"""first as (select *, case when next_ms is not null then greatest(next_ms, {NOW_MS}) when last_ms is not null then last_ms + greatest(1, cast(ceil(({NOW_MS} - last_ms) / every_ms) as bigint)) * every_ms else {NOW_MS} end as first_ms
    from plan where every_ms is not null)"""


def upcoming(spark, d) -> DataFrame:
    """With the first fire from now on: the known next run (now, if that has passed), else the last run's grid."""
    steps = F.greatest(F.lit(1), F.ceil((F.lit(NOW_MS) - F.col("last_ms")) / F.col("every_ms"))).cast("long")
    first = F.when(F.col("next_ms").isNotNull(), F.greatest("next_ms", F.lit(NOW_MS))).when(F.col("last_ms").isNotNull(), F.col("last_ms") + steps * F.col("every_ms")).otherwise(F.lit(NOW_MS))
    return plans(spark, d).where("every_ms is not null").withColumn("first_ms", first)


@query(f"with {PLAN}, {FIRST} select robot_id, first_ms, case when first_ms > {NOW_MS + 24 * HOUR} then 0 else ({NOW_MS + 24 * HOUR} - first_ms) // every_ms + 1 end as fires from first", "runs")
def dt_interval_count(spark, d):
    n = F.floor((F.lit(NOW_MS + 24 * HOUR) - F.col("first_ms")) / F.col("every_ms")) + 1
    return upcoming(spark, d).select("robot_id", "first_ms", F.when(F.col("first_ms") > NOW_MS + 24 * HOUR, F.lit(0)).otherwise(n).cast("long").alias("fires"))


#: Fires of the next day on the grid of the next or last run: the first point of that grid from now on.
GRID = f"grid as (select robot_id, every_ms, {NOW_MS} + (((coalesce(next_ms, last_ms, {NOW_MS}) - {NOW_MS}) % every_ms) + every_ms) % every_ms as start_ms from plan where every_ms is not null)"
FIRES = f"fires as (select robot_id, unnest(range(start_ms, {NOW_MS + 24 * HOUR} + 1, every_ms)) as fire_ms from grid)"


def fires(spark, d) -> DataFrame:
    start = F.lit(NOW_MS) + F.pmod(F.coalesce("next_ms", "last_ms", F.lit(NOW_MS)) - NOW_MS, F.col("every_ms"))
    grid = plans(spark, d).where("every_ms is not null").withColumn("start_ms", start).where(F.col("start_ms") <= NOW_MS + 24 * HOUR)
    return grid.select("robot_id", F.explode(F.sequence("start_ms", F.lit(NOW_MS + 24 * HOUR), "every_ms")).alias("fire_ms"))


@query(f"with {PLAN}, {GRID}, {FIRES} select robot_id, fire_ms from fires", "runs")
def dt_interval_fires(spark, d):
    return fires(spark, d)


@query(f"with {PLAN}, {GRID}, {FIRES} select (fire_ms + 19800000) // {HOUR} % 24 as hour, count(*) as n from fires group by 1", "runs")
def hp_heatmap(spark, d):
    """Fires of the next day by local hour."""
    return fires(spark, d).groupBy((F.floor((F.col("fire_ms") + 19_800_000) / HOUR) % 24).alias("hour")).agg(F.count("*").alias("n"))


@query("select run_id, cast(least(3600000, pow(2, run_id % 12) * 15000) as bigint) as delay_ms from runs", "runs")
def dt_backoff(spark, d):
    return runs(spark, d).select("run_id", F.least(F.lit(3_600_000.0), F.pow(F.lit(2.0), F.col("run_id") % 12) * 15_000).cast("long").alias("delay_ms"))


@query("select run_id, cast(floor(base * 0.8 + (run_id % 10) / 10.0 * (base * 0.4)) as bigint) as delay_ms from (select run_id, [30000, 120000, 600000][least(2, run_id % 5) + 1] as base from runs)", "runs")
def dt_retry_delay(spark, d):
    """A step of the table, with a jitter of a fifth; the run's last digit stands for the random number."""
    base = F.element_at(F.array(*map(F.lit, (30_000, 120_000, 600_000))), (F.least(F.lit(2), F.col("run_id") % 5) + 1).cast("int"))
    return runs(spark, d).select("run_id", F.floor(base * F.lit(0.8) + F.col("run_id") % 10 / 10 * (base * F.lit(0.4))).cast("long").alias("delay_ms"))


@query("select run_id, case when duration_ms is null then 15000 else least(60000, greatest(5000, duration_ms)) end as ttl_ms from runs", "runs")
def mt_clamp(spark, d):
    return runs(spark, d).select("run_id", F.when(F.col("duration_ms").isNull(), 15_000).otherwise(F.least(F.lit(60_000), F.greatest(F.lit(5_000), "duration_ms"))).alias("ttl_ms"))


_stated = "case page_id % 4 when 0 then '' when 1 then (page_id % 13) || '+ years' when 2 then 'about ' || (page_id % 7) else 'none' end"


@query(f"select page_id, coalesce(try_cast(regexp_replace({_stated}, '\\D', '', 'g') as integer), 0) as years from listings", "listings")
def mt_experience(spark, d):
    stated = F.expr("case page_id % 4 when 0 then '' when 1 then concat(page_id % 13, '+ years') when 2 then concat('about ', page_id % 7) else 'none' end")
    return listings(spark, d).select("page_id", F.coalesce(F.regexp_replace(stated, r"\D", "").try_cast("int"), F.lit(0)).alias("years"))


@query("select page_id, greatest(page_id % 13, page_id % 7) as years from listings", "listings")
def sc_experience_merge(spark, d):
    return listings(spark, d).select("page_id", F.greatest(F.col("page_id") % 13, F.col("page_id") % 7).alias("years"))


def texts() -> F.Column:
    """The row's own texts, trimmed, without blanks."""
    return F.filter(F.transform(F.array("company", F.concat(F.lit(" "), "location"), "category", "employment"), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


TEXTS = "list_filter([trim(coalesce(x, '')) for x in [company, ' ' || location, category, employment]], lambda x: x <> '')"


@query(f"select page_id, array_to_string({TEXTS}, '|') as items, len({TEXTS}) as n from listings", "listings")
def ar_string_list(spark, d):
    return listings(spark, d).select("page_id", F.array_join(texts(), "|").alias("items"), F.size(texts()).alias("n"))


@query(f"select page_id, coalesce(nullif(trim(company), ''), nullif(array_to_string({TEXTS}, ', '), ''), '') as first from listings", "listings")
def ar_first_string(spark, d):
    """The first that is not blank; a list counts as its texts, joined."""
    return listings(spark, d).select("page_id", F.coalesce(nz(F.col("company")), nz(F.array_join(texts(), ", ")), F.lit("")).alias("first"))


@query("select run_id, rtrim(translate(to_base64(encode('{\"at\":' || at_ms || ',\"id\":' || run_id || '}')), '+/', '-_'), '=') as cursor, run_id as decoded from runs", "runs")
def js_cursor(spark, d):
    """The cursor in the URL-safe alphabet without padding, and the id read back from it."""
    rows = runs(spark, d).select("run_id", F.rtrim(F.translate(F.base64(F.to_json(F.struct(F.col("at_ms").alias("at"), F.col("run_id").alias("id"))).cast("binary")), "+/", "-_"), F.lit("=")).alias("cursor"))
    plain = F.translate("cursor", "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length("cursor") / 4) * 4).cast("int"), F.lit("="))
    return rows.withColumn("decoded", F.get_json_object(F.unbase64(padded).cast("string"), "$.id").cast("long"))


# Tags and key sets


@query("select robot_id from robots where list_has_all(tags, ['segment:BUILDING'])", "robots")
def flt_tags_all(spark, d):
    return robots(spark, d).where(F.size(F.array_except(F.array(F.lit("segment:BUILDING")), "tags")) == 0).select("robot_id")


@query("select robot_id, case when list_contains(tags, 'segment:BUILDING') then tags else list_append(tags, 'segment:BUILDING') end as tags from robots where tags[1] is not null and tags[2] is not null", "robots")
def set_add_to_set(spark, d):
    return robots(spark, d).where("tags[0] is not null and tags[1] is not null").select("robot_id", F.array_union("tags", F.array(F.lit("segment:BUILDING"))).alias("tags"))


@query("select robot_id, left(tag, instr(tag, ':') - 1) as namespace, substr(tag, instr(tag, ':') + 1) as value from (select robot_id, unnest(tags) as tag from robots) where instr(tag, ':') > 1", "robots")
def fn_tag_parse(spark, d):
    at = F.instr("tag", F.lit(":"))
    rows = robots(spark, d).select("robot_id", F.explode("tags").alias("tag")).where(at > 1)
    return rows.select("robot_id", F.expr("left(tag, instr(tag, ':') - 1)").alias("namespace"), F.expr("substr(tag, instr(tag, ':') + 1)").alias("value"))


KEYS = ("category", "company", "employment", "location", "source", "title")
_keys = "list_filter([" + ", ".join(f"case when trim({k}) <> '' then '{k}' end" for k in KEYS) + "], lambda x: x is not null)"


def keys() -> F.Column:
    """Names of the fields that a row has."""
    return F.filter(F.array(*(F.when(F.trim(k) != "", F.lit(k)) for k in KEYS)), lambda x: x.isNotNull())


@query(f"select distinct source, unnest({_keys}) as key from listings", "listings")
def agg_json_keys(spark, d):
    """Distinct keys of the rows' JSON objects, for each source."""
    rows = listings(spark, d).select("source", F.to_json(F.struct(*(nz(F.col(k)).alias(k) for k in KEYS))).alias("data"))
    return rows.select("source", F.explode(F.json_object_keys("data")).alias("key")).distinct()


@query(f"select page_id, list_sort(list_distinct({_keys} || ['host', 'title'])) as columns from listings", "listings")
def set_union_columns(spark, d):
    return listings(spark, d).select("page_id", F.array_sort(F.array_union(keys(), F.array(F.lit("host"), F.lit("title")))).alias("columns"))


@query(f"select page_id, list_filter({_keys}, lambda x: x not in ('source', 'title')) as columns from listings", "listings")
def set_difference_columns(spark, d):
    return listings(spark, d).select("page_id", F.array_except(keys(), F.array(F.lit("source"), F.lit("title"))).alias("columns"))


@query("select 'ready' as bucket, page_id, method, null as employment from listings where status = 'ready' union all select 'partial', page_id, null, employment from listings where status = 'partial' union all select 'queued', page_id, method, employment from listings where status = 'queued'", "listings")
def set_union_rows(spark, d):
    """Rows of several buckets with different columns."""
    rows = listings(spark, d)
    part = lambda s, *columns: rows.where(F.col("status") == s).select(F.lit(s).alias("bucket"), "page_id", *columns)
    return part("ready", "method").unionByName(part("partial", "employment"), allowMissingColumns=True).unionByName(part("queued", "method", "employment"), allowMissingColumns=True)


@query("select page_id from listings where trim(coalesce(company, '')) <> '' or trim(coalesce(location, '')) <> '' or trim(coalesce(category, '')) <> ''", "listings")
def flt_meaningful_row(spark, d):
    return listings(spark, d).where(F.exists(F.array("company", "location", "category"), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).select("page_id")


# Fields of a record

SYMBOLS = (("USD", "$"), ("EUR", "€"), ("GBP", "£"), ("INR", "₹"), ("JPY", "¥"), ("CAD", "CA$"), ("AUD", "A$"))  # fixed values
_symbols = " ".join(f"when '{c}' then '{s}'" for c, s in SYMBOLS)
PAY = "pay as (select p_partkey, ['usd', 'EUR', 'Gbp', 'CHF', ''][p_partkey % 5 + 1] as currency, case when p_partkey % 3 <> 0 then cast(floor(p_retailprice) as bigint) end as low, case when p_partkey % 4 <> 0 then cast(floor(p_retailprice * 10) as bigint) end as high from part)"
SYMBOL = f"case upper(coalesce(nullif(currency, ''), 'USD')) {_symbols} else upper(currency) || ' ' end"


def pay(spark, d) -> DataFrame:
    currency = F.element_at(F.array(*map(F.lit, ("usd", "EUR", "Gbp", "CHF", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    low, high = F.floor("p_retailprice").cast("long"), F.floor(F.col("p_retailprice") * 10).cast("long")
    return table(spark, d, "part").select("p_partkey", currency.alias("currency"), F.when(F.col("p_partkey") % 3 != 0, low).alias("low"), F.when(F.col("p_partkey") % 4 != 0, high).alias("high"))


def symbol() -> F.Column:
    code = F.upper(F.coalesce(nz(F.col("currency")), F.lit("USD")))
    found = F.concat(code, F.lit(" "))
    for c, s in SYMBOLS:
        found = F.when(code == c, s).otherwise(found)
    return found


@query(f"with {PAY} select p_partkey, {SYMBOL} as symbol from pay")
def fn_currency_symbol(spark, d):
    return pay(spark, d).select("p_partkey", symbol().alias("symbol"))


def _short(c: str) -> str:
    return f"case when {c} >= 1000 then cast(cast(round({c} / 1000.0) as bigint) as varchar) || 'K' else cast({c} as varchar) end"


@query(f"with {PAY} select p_partkey, case when low is null and high is null then '' else {SYMBOL} || case when high is null then {_short('low')} || '+' when low is null then 'up to ' || {_short('high')} else {_short('low')} || '-' || {_short('high')} end || ' / year' end as salary from pay")
def fn_salary_format(spark, d):
    """A range, an open end or nothing; thousands as K."""
    short = lambda c: F.when(F.col(c) >= 1000, F.concat(F.round(F.col(c) / 1000).cast("long").cast("string"), F.lit("K"))).otherwise(F.col(c).cast("string"))
    amount = F.when(F.col("high").isNull(), F.concat(short("low"), F.lit("+"))).when(F.col("low").isNull(), F.concat(F.lit("up to "), short("high"))).otherwise(F.concat(short("low"), F.lit("-"), short("high")))
    return pay(spark, d).select("p_partkey", F.coalesce(F.concat(symbol(), amount, F.lit(" / year")), F.lit("")).alias("salary"))


_scout = "' sx' || lpad(cast(page_id % 100 as varchar), 2, '0') || case when page_id % 3 = 0 then 'a1' else 'ab' end || lpad(cast(page_id % 89 as varchar), 2, '0')"


@query(f"select page_id, upper(trim({_scout})) as scout_id, regexp_full_match(upper(trim({_scout})), 'SX\\d{{2}}[A-Z]{{2}}\\d{{2}}') as valid from listings", "listings")
def fn_scout_id(spark, d):
    two = lambda n: F.lpad((F.col("page_id") % n).cast("string"), 2, "0")
    code = F.upper(F.trim(F.concat(F.lit(" sx"), two(100), F.when(F.col("page_id") % 3 == 0, "a1").otherwise("ab"), two(89))))
    return listings(spark, d).select("page_id", code.alias("scout_id"), code.rlike(r"^SX\d{2}[A-Z]{2}\d{2}$").alias("valid"))


@query("select page_id, upper(left(s, 1)) || substr(s, 2) as label from (select page_id, trim(regexp_replace(regexp_replace(method || '_' || status || 'AtHost-' || host, '[_-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')) as s from listings)", "listings")
def fn_label(spark, d):
    """Words of a column name in snake, kebab or camel case."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.concat("method", F.lit("_"), "status", F.lit("AtHost-"), "host"), "[_-]+", " "), "([a-z])([A-Z])", "$1 $2"))
    return listings(spark, d).select("page_id", words.alias("s")).select("page_id", F.concat(F.upper(F.expr("left(s, 1)")), F.expr("substr(s, 2)")).alias("label"))


_repeated = "'https://www.google.com/about/careers/applications/jobs/' || case when page_id % 2 = 0 then 'jobs/' else '' end || 'results/' || repeat('jobs/results/', page_id % 4) || page_id || '?q=a'"


@query(f"select page_id, regexp_replace({_repeated}, '(/about/careers/applications/jobs)(?:/jobs)?/results(?:/jobs/results)*([/?#]|$)', '\\1/results\\2') as url from listings", "listings")
def fn_url_heal(spark, d):
    """A path segment that wrong joins have repeated, once."""
    raw = F.concat(F.lit("https://www.google.com/about/careers/applications/jobs/"), F.when(F.col("page_id") % 2 == 0, "jobs/").otherwise(""), F.lit("results/"), F.expr("repeat('jobs/results/', cast(page_id % 4 as int))"), F.col("page_id").cast("string"), F.lit("?q=a"))
    return listings(spark, d).select("page_id", F.regexp_replace(raw, r"(/about/careers/applications/jobs)(?:/jobs)?/results(?:/jobs/results)*([/?#]|$)", "$1/results$2").alias("url"))


# Joins and state


NEAR_MS = 120_000
NEAREST = f"""a as (select run_id, robot_id, at_ms, rows_extracted from runs where status = 'failed'), b as (select run_id as other_id, robot_id, at_ms as other_ms, rows_extracted as total from runs where status = 'success'),
    near as (select a.*, other_id, total, row_number() over (partition by run_id order by abs(at_ms - other_ms), other_ms, other_id) as k from a join b on a.robot_id = b.robot_id and abs(at_ms - other_ms) <= {NEAR_MS})"""


def nearest(spark, d) -> DataFrame:
    """Each failed run with the success of its robot nearest in time, at most two minutes away; the earlier one of two. Time slots of that width make it an equality join with three slots."""
    log = runs(spark, d)
    slot = F.floor(F.col("at_ms") / NEAR_MS)
    a = log.where("status = 'failed'").select("run_id", "robot_id", "at_ms", "rows_extracted", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    b = log.where("status = 'success'").select(F.col("run_id").alias("other_id"), "robot_id", F.col("at_ms").alias("other_ms"), F.col("rows_extracted").alias("total"), slot.alias("slot"))
    away = F.abs(F.col("at_ms") - F.col("other_ms"))
    best = F.min(F.struct(away.alias("away"), "other_ms", "other_id", "total")).alias("x")
    return a.join(b, ["robot_id", "slot"]).where(away <= NEAR_MS).groupBy("run_id", "robot_id", "at_ms", "rows_extracted").agg(best).select("run_id", "rows_extracted", "x.other_id", "x.total")


@query(f"with {NEAREST} select run_id, other_id from near where k = 1", "runs")
def jn_nearest_asof(spark, d):
    return nearest(spark, d).select("run_id", "other_id")


@query(f"with {NEAREST} select run_id, least(100.0, greatest(0.0, 100.0 * (1 - rows_extracted / total))) as used_pct from near where k = 1 and total > 0", "runs")
def jn_used_pct(spark, d):
    used = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (1 - F.col("rows_extracted") / F.col("total"))))
    return nearest(spark, d).where("total > 0").select("run_id", used.alias("used_pct"))


@query("select page_id, host from listings where host not in (select host from listings where status = 'ready')", "listings")
def jn_anti_visited(spark, d):
    """Pages of hosts that were not visited yet."""
    rows = listings(spark, d).select("page_id", "host", "status")
    return rows.join(rows.where("status = 'ready'").select("host").distinct(), "host", "left_anti").select("page_id", "host")


@query("select robot_id, count(duration_ms) as n, avg(duration_ms) as mean_ms from runs group by robot_id", "runs")
def agg_running_avg(spark, d):
    return runs(spark, d).groupBy("robot_id").agg(F.count("duration_ms").alias("n"), F.avg("duration_ms").alias("mean_ms"))


@query("select robot_id, case when sum(dt) > 0 then sum(v * dt) / sum(dt) end as mean, max(v) as most, arg_max(v, at_ms) as latest from (select robot_id, at_ms, v, case when at_ms > before then at_ms - before end as dt from (select robot_id, at_ms, max(rows_extracted) as v, lag(at_ms) over (partition by robot_id order by at_ms) as before from runs group by robot_id, at_ms)) group by robot_id", "runs")
def agg_summary_series(spark, d):
    """Mean weighted by time, largest and latest value of each robot's series."""
    points = runs(spark, d).groupBy("robot_id", "at_ms").agg(F.max("rows_extracted").alias("v"))
    dt = F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy("robot_id").orderBy("at_ms"))
    points = points.withColumn("dt", dt)
    return points.groupBy("robot_id").agg(F.try_divide(F.sum(F.col("v") * F.col("dt")), F.sum("dt")).alias("mean"), F.max("v").alias("most"), F.max_by("v", "at_ms").alias("latest"))
