"""Helpers of the record, schedule and dashboard views: one small rule each, beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.operators.records import HOUR, NOW_MS, PRESETS
from harvestry.plans.views import listings, robots, runs, table
from harvestry.registry import query

DAY, IST_MS = 24 * HOUR, 19_800_000
#: The two days of sane durations, and the silence after which a running run counts as lost.
MOST_MS, STALE_MS = 48 * HOUR, 120_000


def pick(column, *values):
    """The value of a fixed list that a number chooses."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


def pick_sql(column: str, *values) -> str:
    quoted = ", ".join("null" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"[{quoted}][{column} % {len(values)} + 1]"


# Failures and fetch tiers


#: Marks of network faults, blocks and tunnel faults in an error text.
TUNNEL = r"(?i)ERR_TUNNEL_CONNECTION_FAILED|ERR_PROXY_CONNECTION_FAILED|ERR_PROXY"
NETWORK = r"(?i)net::ERR_FAILED|ERR_CONNECTION_RESET|ERR_CONNECTION_CLOSED|ERR_CONNECTION_REFUSED|ERR_CONNECTION_TIMED_OUT|ERR_NAME_NOT_RESOLVED|ERR_INTERNET_DISCONNECTED|ERR_NETWORK_CHANGED|ERR_ADDRESS_UNREACHABLE|ERR_TIMED_OUT|ECONNRESET|ETIMEDOUT|ENOTFOUND|socket hang up"
BLOCK = r"(?i)captcha|cloudflare|challenge|access denied|blocked|forbidden|anti-?bot|verification required|attention required|just a moment|Target page, context or browser has been closed|browser has been closed|empty/blocked|empty extraction|soft.?block"
WALL = r"(?i)cf-challenge|captcha|just a moment|attention required|access denied|bot.?detection"
FAULTS = ("net::ERR_TUNNEL_CONNECTION_FAILED at x", "page.goto: ERR_HTTP2_PROTOCOL_ERROR", "connect ETIMEDOUT 10.0.0.1", "403 Forbidden by cloudflare", "Timeout 30000ms", "captcha after ECONNRESET", "escalate_from_tier_3_status_403", "tier_3_status_52", "job_tier_3_status_503 seen", None)


@query(f"select run_id, case when regexp_matches(m, '{TUNNEL}') then 'proxyTunnel' when regexp_matches(m, '{NETWORK}') then 'networkOrOom' when regexp_matches(m, '{BLOCK}') then 'blockLike' else 'networkOrOom' end as kind from (select run_id, coalesce({pick_sql('run_id', *FAULTS)}, '') as m from runs)", "runs")
def hp_escalation_class(spark, d):
    """What a failed fetch calls for: another tunnel, nothing, or a way round a block; a network fault goes before a block."""
    m = F.coalesce(pick(F.col("run_id"), *FAULTS), F.lit(""))
    return runs(spark, d).select("run_id", F.when(m.rlike(TUNNEL), "proxyTunnel").when(m.rlike(NETWORK), "networkOrOom").when(m.rlike(BLOCK), "blockLike").otherwise("networkOrOom").alias("kind"))


@query(f"select run_id, coalesce(regexp_matches({pick_sql('run_id', *FAULTS)}, '(?i)\\bERR_HTTP2_PROTOCOL_ERROR\\b'), false) as http2 from runs", "runs")
def hp_http2_class(spark, d):
    return runs(spark, d).select("run_id", F.coalesce(pick(F.col("run_id"), *FAULTS).rlike(r"(?i)\bERR_HTTP2_PROTOCOL_ERROR\b"), F.lit(False)).alias("http2"))


@query("select run_id, list_transform(range(least(greatest(1, case when run_id % 2 = 0 then run_id % 5 else run_id % 3 + 1 end), run_id % 4 + 1), run_id % 4 + 2), lambda x: x::int) as tiers from runs", "runs")
def hp_tiers_to_try(spark, d):
    """Fetch tiers from the learned one, or the one asked for, up to the dearest allowed."""
    learned, asked, most = F.col("run_id") % 5, F.col("run_id") % 3 + 1, F.col("run_id") % 4 + 1
    start = F.least(F.greatest(F.lit(1), F.when(F.col("run_id") % 2 == 0, learned).otherwise(asked)), most)
    return runs(spark, d).select("run_id", F.sequence(start.cast("int"), most.cast("int")).alias("tiers"))


@query(f"select run_id, status = 'failed' and run_id % 4 >= 3 and regexp_matches(coalesce({pick_sql('run_id', *FAULTS)}, ''), '(?i)(?:^|_)tier_3_status_[0-9]{{3}}\\b|escalate_from_tier_3_status_[0-9]{{3}}\\b') as retry from runs", "runs")
def hp_browser_fallback(spark, d):
    """A browser is tried only where the dearest tier was turned away with a status."""
    m = F.coalesce(pick(F.col("run_id"), *FAULTS), F.lit(""))
    return runs(spark, d).select("run_id", ((F.col("status") == "failed") & (F.col("run_id") % 4 >= 3) & m.rlike(r"(?i)(?:^|_)tier_3_status_[0-9]{3}\b|escalate_from_tier_3_status_[0-9]{3}\b")).alias("retry"))


LINES = ("Search execution error: no results ", "step 1 ok", " Crawl action failed: robots", "Search action failed:", "done")
_log = f"[{pick_sql('run_id', *LINES)}, {pick_sql('(run_id // 2)', *LINES)}, {pick_sql('(run_id // 3)', *LINES)}]"
MARKERS = "Search execution error:|Search action failed:|Crawl execution error:|Crawl action failed:"


@query(f"select run_id, coalesce(nullif(trim(list_filter({_log}, lambda x: regexp_matches(x, '{MARKERS}'))[1]), ''), 'failed') as reason from runs", "runs")
def hp_log_reason(spark, d):
    """The first log line with a marker of a failed search or crawl."""
    log = F.array(*[pick(F.floor(F.col("run_id") / k), *LINES) for k in (1, 2, 3)])
    line = F.get(F.filter(log, lambda x: x.rlike(MARKERS)), F.lit(0))
    return runs(spark, d).select("run_id", F.coalesce(F.nullif(F.trim(line), F.lit("")), F.lit("failed")).alias("reason"))


@query(f"select run_id, coalesce({NOW_MS} - case when run_id % 3 = 0 then null else at_ms end >= {STALE_MS}, {NOW_MS} - case when run_id % 6 = 0 then null else started_ms end >= {STALE_MS}, true) as stale from runs where status = 'running'", "runs")
def hp_lease_stale(spark, d):
    """A running run is lost if its last heartbeat, or its start where there is none, is too long ago; without either it is."""
    beat, start = F.when(F.col("run_id") % 3 != 0, F.col("at_ms")), F.when(F.col("run_id") % 6 != 0, F.col("started_ms"))
    old = lambda t: F.lit(NOW_MS) - t >= STALE_MS
    return runs(spark, d).where("status = 'running'").select("run_id", F.coalesce(old(beat), old(start), F.lit(True)).alias("stale"))


@query(f"select page_id, s in (403, 503, 429) or html = '' or regexp_matches(left(html, 8000), '{WALL}') or octet_length(encode(html)) < 1500 as escalate from (select page_id, [200, 403, 404, 429, 503][page_id % 5 + 1] as s, case when page_id % 11 = 0 then '' when page_id % 13 = 0 then '<p>Just a moment...</p>' || repeat('x', 2000) else html end as html from pages)")
def flt_escalate(spark, d):
    """Fetches that a dearer tier repeats: refused, walled off, or too small to be a page."""
    html = F.when(F.col("page_id") % 11 == 0, "").when(F.col("page_id") % 13 == 0, F.concat(F.lit("<p>Just a moment...</p>"), F.expr("repeat('x', 2000)"))).otherwise(F.col("html"))
    rows = table(spark, d, "pages").select("page_id", html.alias("html"), pick(F.col("page_id"), 200, 403, 404, 429, 503).alias("s"))
    sure = F.col("s").isin(403, 503, 429) | (F.col("html") == "") | F.substring("html", 1, 8000).rlike(WALL) | (F.octet_length("html") < 1500)
    return rows.select("page_id", sure.alias("escalate"))


# Parameters


@query(f"select run_id, coalesce(case when w in ('15m', '30m', '1h', '3h', '6h', '24h') then w end, '1h') as w from (select run_id, lower(trim({pick_sql('run_id', '15m', ' 3H ', '2h', None, '24h', '')})) as w from runs)", "runs", name="hp_ops_window_parse")
def hp_ops_window_parse(spark, d):
    w = F.lower(F.trim(pick(F.col("run_id"), "15m", " 3H ", "2h", None, "24h", "")))
    return runs(spark, d).select("run_id", F.when(w.isin("15m", "30m", "1h", "3h", "6h", "24h"), w).otherwise("1h").alias("w"))


#: Output formats of a robot.
FORMATS = ("markdown", "html", "text", "links", "screenshot-visible", "screenshot-fullpage")
_asked = f"[{pick_sql('run_id', *FORMATS)}, {pick_sql('(run_id // 3)', 'pdf', 'text', 'HTML')}, 'links']"
_formats = ", ".join(f"'{f}'" for f in FORMATS)


@query(f"select run_id, list_filter({_asked}, lambda x: x in ({_formats})) as valid, list_filter({_asked}, lambda x: x not in ({_formats})) as invalid from runs", "runs")
def hp_formats_parse(spark, d):
    asked = F.array(pick(F.col("run_id"), *FORMATS), pick(F.floor(F.col("run_id") / 3), "pdf", "text", "HTML"), F.lit("links"))
    return runs(spark, d).select("run_id", F.filter(asked, lambda x: x.isin(*FORMATS)).alias("valid"), F.filter(asked, lambda x: ~x.isin(*FORMATS)).alias("invalid"))


@query(f"select run_id, case when n is null then 50 else least(200, greatest(1, floor(n))) end::int as pages from (select run_id, try_cast({pick_sql('run_id', '7', '0', '999', 'x', '12.8', '-3', '')} as double) as n from runs)", "runs")
def hp_crawl_limit(spark, d):
    n = pick(F.col("run_id"), "7", "0", "999", "x", "12.8", "-3", "").try_cast("double")
    return runs(spark, d).select("run_id", F.when(n.isNull(), 50).otherwise(F.least(F.lit(200), F.greatest(F.lit(1), F.floor(n)))).cast("int").alias("pages"))


@query("select robot_id, t as tag from (select robot_id, unnest(tags) as t from robots) where t in ('segment:BUILDING', 'nation:FRANCE', 'nation:CHINA')", "robots")
def hp_tag_select(spark, d):
    """The tags chosen for the dashboard, of every robot."""
    return robots(spark, d).select("robot_id", F.explode("tags").alias("tag")).where(F.col("tag").isin("segment:BUILDING", "nation:FRANCE", "nation:CHINA"))


#: A robot has so many tags at most.
MOST_TAGS = 5
_raw_tags = "[' segment:BUILDING', 'nation:FRANCE ', '', 'segment:BUILDING', case when robot_id % 4 = 0 then 'odd:tag' else 'nation:PERU' end]"


@query(f"select robot_id, case when len(list_filter(t, lambda x: not regexp_full_match(x, '(segment|nation):.+'))) > 0 then null else list_distinct_ordered end as tags, case when len(list_filter(t, lambda x: not regexp_full_match(x, '(segment|nation):.+'))) > 0 then 'Unknown or disallowed tag: ' || list_filter(t, lambda x: not regexp_full_match(x, '(segment|nation):.+'))[1] end as error from (select robot_id, t, list_filter(t, lambda x, i: list_position(t, x) = i) as list_distinct_ordered from (select robot_id, list_filter(list_transform({_raw_tags}, lambda x: trim(x)), lambda x: x <> '') as t from robots))", "robots")
def hp_tags_sanitize(spark, d):
    """Trimmed tags of the catalogue's namespaces, each once; the first other one, or too many, is an error instead."""
    raw = F.array(F.lit(" segment:BUILDING"), F.lit("nation:FRANCE "), F.lit(""), F.lit("segment:BUILDING"), F.when(F.col("robot_id") % 4 == 0, "odd:tag").otherwise("nation:PERU"))
    t = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")
    bad = F.get(F.filter(t, lambda x: ~x.rlike("^(segment|nation):.+$")), F.lit(0))
    tags = F.array_distinct(t)
    error = F.when(bad.isNotNull(), F.concat(F.lit("Unknown or disallowed tag: "), bad)).when(F.size(tags) > MOST_TAGS, F.lit(f"At most {MOST_TAGS} tags are allowed per automation"))
    return robots(spark, d).select("robot_id", F.when(error.isNull(), tags).alias("tags"), error.alias("error"))


EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
_mails = "name || '@x.org, ' || upper(name) || '@X.org;bad@x  ' || coalesce(company, 'a') || '@y.de'"
_mail_list = f"list_filter(string_split_regex({_mails}, '[,;\\s]+'), lambda x: regexp_matches(x, '{EMAIL}'))"


def emails(c) -> F.Column:
    """Addresses of a list in any form, each once whatever its case: the first spelling, in the first order."""
    parts = F.filter(F.split(c, r"[,;\s]+"), lambda x: x.rlike(EMAIL))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.array_append(seen, x)))


@query(f"select robot_id, list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i) as emails from (select robot_id, {_mail_list} as m from robots)", "robots")
def hp_digest_emails(spark, d):
    return robots(spark, d).select("robot_id", emails(F.expr(_mails)).alias("emails"))


@query(f"select owner, list_sort(list(distinct lower(x))) as emails from (select owner, unnest({_mail_list}) as x from robots where name is not null) group by owner", "robots")
def hp_email_list(spark, d):
    """The digest's recipients of each owner, over all robots."""
    rows = robots(spark, d).where("name is not null").select("owner", F.explode(emails(F.expr(_mails))).alias("x"))
    return rows.groupBy("owner").agg(F.array_sort(F.collect_set(F.lower("x"))).alias("emails"))


# Times


@query("select run_id, case when t < 1000000000000 then cast(round(t * 1000) as bigint) else cast(t as bigint) end as ms from (select run_id, case when run_id % 2 = 0 then at_ms / 1000.0 else at_ms end as t from runs)", "runs")
def hp_chart_ts(spark, d):
    """Chart times in milliseconds, whichever unit they came in."""
    t = F.when(F.col("run_id") % 2 == 0, F.col("at_ms") / 1000.0).otherwise(F.col("at_ms"))
    return runs(spark, d).select("run_id", F.when(t < 1e12, F.round(t * 1000)).otherwise(t).cast("long").alias("ms"))


_posted = "case when page_id % 3 = 0 then null else created_ms - page_id % 5 * 3600000 + case when page_id % 7 = 0 then 999999999999 else 0 end end"


@query(f"select page_id, case when p <= {NOW_MS} then p else coalesce(c, p) end as shown_ms from (select page_id, {_posted} as p, case when page_id % 4 <> 0 then created_ms end as c from listings)", "listings")
def hp_display_instant(spark, d):
    """The posted time unless it lies ahead, else the time of creation."""
    rows = listings(spark, d).select("page_id", F.expr(_posted).alias("p"), F.when(F.col("page_id") % 4 != 0, F.col("created_ms")).alias("c"))
    return rows.select("page_id", F.when(F.col("p") <= NOW_MS, F.col("p")).otherwise(F.coalesce("c", "p")).alias("shown_ms"))


@query(f"select page_id, case when n < 0 or n >= 30 then strftime(make_timestamp(created_ms * 1000), '%b %-d, %Y') when n = 0 then 'Today' when n = 1 then 'Yesterday' when n < 7 then n || 'd ago' else n // 7 || 'w ago' end as age from (select page_id, created_ms, cast(floor(({NOW_MS} - created_ms) / {DAY}.0) as bigint) as n from listings)", "listings")
def hp_relative_time(spark, d):
    """Days or weeks since a listing came, or its date if that is long ago or ahead."""
    n = F.floor((F.lit(NOW_MS) - F.col("created_ms")) / DAY)
    date = F.date_format(F.timestamp_millis("created_ms"), "MMM d, yyyy")
    label = F.when((n < 0) | (n >= 30), date).when(n == 0, "Today").when(n == 1, "Yesterday").when(n < 7, F.concat(n.cast("string"), F.lit("d ago"))).otherwise(F.concat(F.floor(n / 7).cast("string"), F.lit("w ago")))
    return listings(spark, d).select("page_id", label.alias("age"))


def ist_day(ms) -> F.Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((ms + IST_MS) / DAY).cast("int"))


_ist = f"(date '1970-01-01' + cast(floor((at_ms + {IST_MS}) / {DAY}.0) as int))"


@query(f"select robot_id, list_transform(range(-3, 4), lambda i: strftime(day + i::int, '%Y-%m-%d')) as strip from (select robot_id, max({_ist}) as day from runs group by robot_id)", "runs")
def dt_day_strip(spark, d):
    """The three calendar days before and after a robot's last run, at +05:30."""
    day = ist_day(F.max("at_ms"))
    strip = F.transform(F.sequence(F.date_sub("day", 3), F.date_add("day", 3)), lambda x: x.cast("string"))
    return runs(spark, d).groupBy("robot_id").agg(day.alias("day")).select("robot_id", strip.alias("strip"))


@query(f"select run_id, {_ist} between date '2024-01-10' and date '2024-01-16' as on_strip from runs", "runs")
def hp_day_strip_member(spark, d):
    return runs(spark, d).select("run_id", ist_day(F.col("at_ms")).between("2024-01-10", "2024-01-16").alias("on_strip"))


CRON_TEXTS = ("0  6 * * 1-5", " */15 * * * *", "0 0 1 *", "", "5 4 3 2 1 0")


@query(f"select robot_id, p[1] as minute, p[2] as hour, p[3] as day_of_month, p[4] as month, p[5] as day_of_week from (select robot_id, string_split_regex(trim({pick_sql('robot_id', *CRON_TEXTS)}), '\\s+') as p from robots) where len(p) = 5", "robots")
def hp_cron_build(spark, d):
    """The five fields of a schedule; other texts have none."""
    p = robots(spark, d).select("robot_id", F.split(F.trim(pick(F.col("robot_id"), *CRON_TEXTS)), r"\s+").alias("p")).where("size(p) = 5")
    return p.select("robot_id", *[F.col("p")[i].alias(n) for i, n in enumerate(("minute", "hour", "day_of_month", "month", "day_of_week"))])


@query(f"select robot_id, max(at_ms) + (robot_id % 4 + 1) * {HOUR} as next_ms from runs group by robot_id", "runs")
def hp_interval_next(spark, d):
    return runs(spark, d).groupBy("robot_id").agg(F.max("at_ms").alias("last")).select("robot_id", (F.col("last") + (F.col("robot_id") % 4 + 1) * HOUR).alias("next_ms"))


_every = "case robot_id % 4 when 0 then null when 1 then 86400000 when 2 then 3600000 else 0 end"
_cron = pick_sql("(robot_id // 4)", "0 0 * * *", "", "0 * * * *", "7 7 * * *")


def preset_ms(cron):
    found = F.lit(None).cast("long")
    for c, ms, _ in PRESETS:
        found = F.when(cron == c, F.lit(ms).cast("long")).otherwise(found)
    return found


_preset = "case c " + " ".join(f"when '{c}' then {ms}" for c, ms, _ in PRESETS) + " end"


@query(f"select robot_id, case when robot_id % 5 = 0 then 'skip' when coalesce(ms, 0) = 0 and c = '' then 'skip' when ms = {DAY} then 'daily' else 'immovable' end as kind from (select robot_id, c, coalesce(case when e > 0 then e end, {_preset}) as ms from (select robot_id, {_every} as e, {_cron} as c from robots))", "robots")
def hp_schedule_kind(spark, d):
    """Daily schedules may be moved by the planner, other enabled ones not; those without an interval are skipped."""
    r = robots(spark, d).select("robot_id", F.expr(_every).alias("e"), pick(F.floor(F.col("robot_id") / 4), "0 0 * * *", "", "0 * * * *", "7 7 * * *").alias("c"))
    ms = F.coalesce(F.when(F.col("e") > 0, F.col("e")), preset_ms(F.col("c")))
    kind = F.when(F.col("robot_id") % 5 == 0, "skip").when((F.coalesce(ms, F.lit(0)) == 0) & (F.col("c") == ""), "skip").when(ms == DAY, "daily").otherwise("immovable")
    return r.select("robot_id", kind.alias("kind"))


# The schedule on the robot and the one in its settings.
STATE = f"""st as (select robot_id, robot_id % 3 = 0 as r_on, {_cron} as r_cron, robot_id % 5 = 0 as s_on, {pick_sql('robot_id', '', '0 0 * * *', '0 * * * *')} as s_cron from robots),
    eff as (select robot_id, case when r_on then 'robot' when s_on then 'settings' when s_cron <> '' then 'settings' else 'robot' end as source, * exclude (robot_id) from st),
    flags as (select robot_id, source, case source when 'robot' then r_on else s_on end as enabled, case source when 'robot' then r_cron else s_cron end as cron from eff)"""


def states(spark, d) -> DataFrame:
    r = robots(spark, d).select(
        "robot_id", (F.col("robot_id") % 3 == 0).alias("r_on"), pick(F.floor(F.col("robot_id") / 4), "0 0 * * *", "", "0 * * * *", "7 7 * * *").alias("r_cron"),
        (F.col("robot_id") % 5 == 0).alias("s_on"), pick(F.col("robot_id"), "", "0 0 * * *", "0 * * * *").alias("s_cron"),
    )
    source = F.when(F.col("r_on"), "robot").when(F.col("s_on") | (F.col("s_cron") != ""), "settings").otherwise("robot")
    own = lambda c: F.when(source == "robot", F.col(f"r_{c}")).otherwise(F.col(f"s_{c}"))
    return r.select("robot_id", source.alias("source"), own("on").alias("enabled"), own("cron").alias("cron"))


@query(f"with {STATE} select * from flags", "robots")
def hp_schedule_state(spark, d):
    """The schedule in force: the enabled one, the robot's first; of two that are off the settings' if they hold an interval."""
    return states(spark, d)


@query(f"with {STATE} select robot_id, enabled and cron <> '' as active, not enabled and cron <> '' as paused from flags", "robots")
def hp_schedule_flags(spark, d):
    return states(spark, d).select("robot_id", (F.col("enabled") & (F.col("cron") != "")).alias("active"), (~F.col("enabled") & (F.col("cron") != "")).alias("paused"))


FINISHES = ("M/d/yyyy, h:mm:ss a", "d/M/yyyy, h:mm:ss a")


@query(f"""with x as (select run_id, started_ms, at_ms, status, duration_ms, case when run_id % 2 = 0 then strftime(make_timestamp(at_ms * 1000), '%-m/%-d/%Y, %-I:%M:%S %p') else strftime(make_timestamp(at_ms * 1000), '%-d/%-m/%Y, %-I:%M:%S %p') end as f from runs),
    c as (select run_id, started_ms, epoch_ms(unnest([try_strptime(f, '%m/%d/%Y, %I:%M:%S %p'), try_strptime(f, '%d/%m/%Y, %I:%M:%S %p')])) as e from x)
    select x.run_id, b.ms from x left join (select run_id, min(e - started_ms) as ms from c where e - started_ms between 0 and {MOST_MS} group by run_id) b using (run_id)""", "runs")  # fmt: skip
def dt_duration_ambig(spark, d):
    """Duration to a local time that may be month first or day first: the shortest that is neither negative nor over two days."""
    return durations(spark, d).select("run_id", "ms")


def durations(spark, d) -> DataFrame:
    stamp = F.timestamp_millis("at_ms")
    text = F.when(F.col("run_id") % 2 == 0, F.date_format(stamp, FINISHES[0])).otherwise(F.date_format(stamp, FINISHES[1]))
    ends = F.transform(F.array(*[F.try_to_timestamp("f", F.lit(x)) for x in FINISHES]), F.unix_millis)
    spans = F.filter(F.transform(ends, lambda e: e - F.col("started_ms")), lambda ms: ms.between(0, MOST_MS))
    return runs(spark, d).withColumn("f", text).withColumn("ms", F.array_min(spans)).select("run_id", "status", "duration_ms", "ms")


@query(f"""with x as (select run_id, started_ms, status, duration_ms, case when run_id % 2 = 0 then strftime(make_timestamp(at_ms * 1000), '%-m/%-d/%Y, %-I:%M:%S %p') else strftime(make_timestamp(at_ms * 1000), '%-d/%-m/%Y, %-I:%M:%S %p') end as f from runs),
    c as (select run_id, started_ms, epoch_ms(unnest([try_strptime(f, '%m/%d/%Y, %I:%M:%S %p'), try_strptime(f, '%d/%m/%Y, %I:%M:%S %p')])) as e from x)
    select x.run_id, case when status = 'running' then null else coalesce(b.ms, case when duration_ms > 0 and duration_ms <= {MOST_MS} then duration_ms end) end as ms from x left join (select run_id, min(e - started_ms) as ms from c where e - started_ms between 0 and {MOST_MS} group by run_id) b using (run_id)""", "runs")  # fmt: skip
def dt_duration_resolve(spark, d):
    """The times decide, then the stored duration if sane; a run under way has none."""
    stored = F.when(F.col("duration_ms").between(1, MOST_MS), F.col("duration_ms"))
    return durations(spark, d).select("run_id", F.when(~F.coalesce(F.col("status") == "running", F.lit(False)), F.coalesce("ms", stored)).alias("ms"))


_dates = ("datePosted", "postedAt", "posted_date", "posted", "date", "listing_date", "created")
DATED = "dated as (select page_id, created_ms, [" + ", ".join(f"case when page_id % {i + 2} = 0 then {['strftime(make_timestamp(created_ms * 1000), chr(37) || chr(89) || chr(45) || chr(37) || chr(109) || chr(45) || chr(37) || chr(100))', chr(39) + 'soon' + chr(39), chr(39) + '2999-01-01' + chr(39)][i % 3]} end" for i in range(len(_dates))) + "] as said from listings)"


@query(f"with {DATED} select page_id, coalesce(list_filter(list_transform(said, lambda x: epoch_ms(try_strptime(x, '%Y-%m-%d'))), lambda t: t <= {NOW_MS})[1], created_ms) as posted_ms from dated", "listings")
def dt_posted(spark, d):
    """The first of seven fields that reads as a time not ahead, else the time of creation."""
    rows = listings(spark, d)
    forms = (F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd"), F.lit("soon"), F.lit("2999-01-01"))
    said = F.array(*[F.when(F.col("page_id") % (i + 2) == 0, forms[i % 3]) for i in range(len(_dates))])
    times = F.filter(F.transform(said, lambda x: F.unix_millis(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")))), lambda t: t <= NOW_MS)
    return rows.select("page_id", F.coalesce(F.get(times, F.lit(0)), "created_ms").alias("posted_ms"))


# Views


@query("select hour, n, case when hi = lo then 0 else cast(floor(4.0 * (n - lo) / (hi - lo) + 0.5) as int) end as shade from (select *, min(n) over () as lo, max(n) over () as hi from (select at_ms // 3600000 % 24 as hour, count(*) as n from runs group by 1))", "runs")
def hp_heatmap_colour(spark, d):
    """Runs by hour of the day, each shaded between the least and the most of all 24."""
    hours = runs(spark, d).groupBy((F.floor(F.col("at_ms") / HOUR) % 24).alias("hour")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # 24 rows at most
    lo, hi = F.min("n").over(every), F.max("n").over(every)
    return hours.select("hour", "n", F.when(hi == lo, 0).otherwise(F.floor(4.0 * (F.col("n") - lo) / (hi - lo) + 0.5)).cast("int").alias("shade"))


@query("select robot_id, case when robot_id % 7 = 0 or robot_id % 11 = 0 then 'webhook' when robot_id % 5 = 0 then 'airtable' when robot_id % 3 = 0 then 'database' else 'none' end as destination from robots", "robots")
def hp_dest_type(spark, d):
    """Where a robot's rows go, by the first destination that its settings enable."""
    config = F.to_json(F.struct((F.col("robot_id") % 7 == 0).alias("webhook"), F.when(F.col("robot_id") % 11 == 0, "https://x").alias("webhookUrl"), (F.col("robot_id") % 5 == 0).alias("airtable"), (F.col("robot_id") % 3 == 0).alias("database")))
    on = lambda k: F.get_json_object("config", f"$.{k}")
    kind = F.when((on("webhook") == "true") | on("webhookUrl").isNotNull(), "webhook").when(on("airtable") == "true", "airtable").when(on("database") == "true", "database").otherwise("none")
    return robots(spark, d).select("robot_id", config.alias("config")).select("robot_id", kind.alias("destination"))


@query("select robot_id, count(*) as n_rows from runs where rows_extracted > 0 and coalesce(status, '') <> 'running' group by robot_id", "runs")
def hp_rows_count(spark, d):
    return runs(spark, d).where((F.col("rows_extracted") > 0) & (F.coalesce("status", F.lit("")) != "running")).groupBy("robot_id").agg(F.count("*").alias("n_rows"))


@query("select r.run_id, coalesce(b.name, '') as robot_name, r.status, coalesce(n.n, 0) as n_later, r.rows_extracted from runs r left join robots b using (robot_id) left join (select retry_of as run_id, count(*) as n from runs where retry_of is not null group by 1) n using (run_id)", "runs robots")
def hp_run_detail(spark, d):
    """A run with its robot's name and how often it was tried again."""
    r = runs(spark, d)
    again = r.where("retry_of is not null").groupBy(F.col("retry_of").alias("run_id")).agg(F.count("*").alias("n"))
    return r.join(robots(spark, d).select("robot_id", "name"), "robot_id", "left").join(again, "run_id", "left").select("run_id", F.coalesce("name", F.lit("")).alias("robot_name"), "status", F.coalesce("n", F.lit(0)).alias("n_later"), "rows_extracted")


@query(f"select method, day, sum(c)::bigint as credits, sum(sum(c)) over (partition by method)::bigint as total from (select method, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') as day, page_id % 26 as c from listings) group by method, day", "listings")
def hp_credit_metrics(spark, d):
    """Credits by method and day, beside the method's total."""
    rows = listings(spark, d).groupBy("method", F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd").alias("day")).agg(F.sum(F.col("page_id") % 26).alias("credits"))
    return rows.withColumn("total", F.sum("credits").over(Window.partitionBy("method")))


# Aggregator rows


#: The aggregator's hosts, and the path of a posting there.
AGGREGATOR = r"(?i)^https?://([^/?#]+[.])?hiring[.]?cafe([/:?#]|$)"
POSTING = r"(?i)^https?://[^/?#]+[^?#]*/job/[^/?#]+"
_links = "case page_id % 6 when 0 then 'https://hiring.cafe/job/' || page_id when 1 then 'https://hiring.cafe/?q=' || page_id when 2 then 'https://www.hiring.cafe/viewjob/1' when 3 then ' ' when 4 then 'mailto:x@y.org' else url end"


@query(f"select page_id, regexp_matches(u, '{AGGREGATOR}') as aggregator, regexp_matches(u, '{AGGREGATOR}') and regexp_matches(u, '{POSTING}') as posting from (select page_id, {_links} as u from listings)", "listings")
def hp_agg_posting_url(spark, d):
    u = F.col("u")
    return listings(spark, d).select("page_id", F.expr(_links).alias("u")).select("page_id", u.rlike(AGGREGATOR).alias("aggregator"), (u.rlike(AGGREGATOR) & u.rlike(POSTING)).alias("posting"))


@query(f"select page_id, regexp_matches(u, '{AGGREGATOR}') as aggregator from (select page_id, {_links} as u from listings)", "listings")
def hp_agg_is_url(spark, d):
    return listings(spark, d).select("page_id", F.expr(_links).rlike(AGGREGATOR).alias("aggregator"))


@query(f"select case when regexp_matches(u, '{AGGREGATOR}') then 'aggregator' else 'career' end as kind, count(*) as n from (select {_links} as u from listings) group by 1", "listings")
def hp_agg_clauses(spark, d):
    """Aggregator and career-site rows: the two filters leave nothing out and share nothing."""
    rows = listings(spark, d).select(F.expr(_links).alias("u"))
    parts = [rows.where(c).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, c in (("aggregator", F.col("u").rlike(AGGREGATOR)), ("career", ~F.col("u").rlike(AGGREGATOR)))]
    return parts[0].union(parts[1]).where("n > 0")


@query(f"select page_id, coalesce(list_filter([trim({_links}), 'ftp://x', trim(url)], lambda u: regexp_matches(u, '(?i)^https?://') and not regexp_matches(u, '{AGGREGATOR}'))[1], '') as apply_url from listings", "listings")
def hp_agg_external_url(spark, d):
    """The first absolute URL that does not lead back to the aggregator."""
    every = F.array(F.trim(F.expr(_links)), F.lit("ftp://x"), F.trim("url"))
    return listings(spark, d).select("page_id", F.coalesce(F.get(F.filter(every, lambda u: u.rlike("(?i)^https?://") & ~u.rlike(AGGREGATOR)), F.lit(0)), F.lit("")).alias("apply_url"))


@query("select page_id, case page_id % 4 when 0 then 'yes' when 1 then 'no' else '' end as visa from listings", "listings")
def hp_agg_visa(spark, d):
    flag = F.get_json_object(F.to_json(F.struct(F.when(F.col("page_id") % 4 == 0, True).when(F.col("page_id") % 4 == 1, False).alias("visa"))), "$.visa")
    return listings(spark, d).select("page_id", F.when(flag == "true", "yes").when(flag == "false", "no").otherwise("").alias("visa"))


_reqs = "case page_id % 5 when 0 then 'https://x.com/job/Pune/Engineer_JR-' || page_id when 1 then 'https://x.com/job/R' || page_id || '?a=1' when 2 then 'https://x.com/a/b/' || page_id when 3 then 'https://x.com/job/Title_R-' || page_id || '-2' else url end"


@query(f"select page_id, coalesce(nullif(replace(regexp_extract(u, '(?i)(?:^|_|/|-)(JR-?[0-9]+)\\b', 1), '-', ''), ''), nullif(replace(regexp_extract(u, '(?i)(?:^|_|/|-)(R-?[0-9]+)\\b', 1), '-', ''), ''), regexp_extract(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '([^/]*)/*$', 1)) as req from (select page_id, {_reqs} as u from listings)", "listings")
def hp_wd_req(spark, d):
    """The requisition in a URL, in either form, or its last path part."""
    u = F.expr(_reqs)
    code = lambda x: F.nullif(F.replace(F.regexp_extract(u, rf"(?i)(?:^|_|/|-)({x}-?[0-9]+)\b", 1), F.lit("-"), F.lit("")), F.lit(""))
    return listings(spark, d).select("page_id", F.coalesce(code("JR"), code("R"), F.regexp_extract(F.regexp_extract(u, "^https?://[^/?#]+([^?#]*)", 1), "([^/]*)/*$", 1)).alias("req"))


_starts = "case page_id % 4 when 0 then 'https://x.com/jobs/list-' || page_id || '/?a=1' when 1 then 'https://x.com/careers/' when 2 then 'https://x.com/about' else 'https://x.com/search#top' end"


@query(f"select page_id, case when page_id % 10 < 2 then null when regexp_matches(p, '-[0-9]+/?$') then b || regexp_replace(p, '-[0-9]+/?$', '-' || page_id % 10) || r when regexp_matches(p, '(?i)jobs|careers|search|portals|vacancies|openings') then b || regexp_replace(p, '/?$', '') || '-' || page_id % 10 || r end as next_url from (select page_id, regexp_extract(u, '^(https?://[^/?#]+)', 1) as b, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) as p, regexp_extract(u, '^[^?#]*(.*)$', 1) as r from (select page_id, {_starts} as u from listings))", "listings")
def hp_path_increment(spark, d):
    """The URL of a list's page: its number at the path's end is set, or put there on paths of job lists."""
    u = F.expr(_starts)
    b, p, r = F.regexp_extract(u, "^(https?://[^/?#]+)", 1), F.regexp_extract(u, "^https?://[^/?#]+([^?#]*)", 1), F.regexp_extract(u, "^[^?#]*(.*)$", 1)
    n = (F.col("page_id") % 10).cast("string")
    plain = F.regexp_extract(p, "^(.*?)/?$", 1)
    made = F.when(p.rlike("-[0-9]+/?$"), F.concat(b, F.regexp_extract(p, "^(.*)-[0-9]+/?$", 1), F.lit("-"), n, r)).when(p.rlike("(?i)jobs|careers|search|portals|vacancies|openings"), F.concat(b, plain, F.lit("-"), n, r))
    return listings(spark, d).select("page_id", F.when(F.col("page_id") % 10 >= 2, made).alias("next_url"))


@query("select page_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title, trim(regexp_replace(description, '\\s+', ' ', 'g')) as description from listings", "listings")
def hp_clean_row(spark, d):
    """Every text of a row with single spaces: the row as a map of its fields."""
    row = F.create_map(F.lit("title"), F.col("title"), F.lit("description"), F.col("description"))
    clean = F.transform_values(row, lambda k, v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    return listings(spark, d).select("page_id", clean.alias("row")).select("page_id", F.col("row.title").alias("title"), F.col("row.description").alias("description"))
