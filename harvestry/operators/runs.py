"""Run analytics: lists, groups, heal suppression, rollups and drift over the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions.reasons import CODES, failure_reason, reason_sql
from harvestry.plans.views import robots, runs
from harvestry.registry import query
from harvestry.sources.storage import fresh_path

SUCCESS, FAILED, ACTIVE = ("success", "completed"), ("failed", "dead", "aborted"), ("running", "pending", "queued")
#: Longest duration taken as real: 48 hours.
SANE_MS = 48 * 3600 * 1000
IST_MS = 19_800_000


def newest_first():
    """Newest run first within a robot. A function: the entry module is also imported without a session."""
    return Window.partitionBy("robot_id").orderBy(F.desc("at_ms"), F.desc("run_id"))


def unhealed(log: DataFrame, ahead: int = 2) -> DataFrame:
    """Failed runs that are not followed by `ahead` successes: the next runs of the robot strictly after it, over the whole log. A null time keeps the row.

    Runs of one time are one group: what follows starts after the last of them.
    """
    order = Window.partitionBy("robot_id").orderBy("at_ms", "run_id")
    bad = (~F.col("status").isin(*SUCCESS)).cast("int")
    first = F.row_number().over(order)
    # position of the first later run, then the statuses of it and the next
    pos = log.withColumn("pos", first)
    same = Window.partitionBy("robot_id", "at_ms")
    pos = pos.withColumn("last_pos", F.max("pos").over(same))
    run = Window.partitionBy("robot_id").orderBy("pos").rowsBetween(1, ahead)
    pos = pos.withColumn("ok", F.when(F.count("*").over(run) == ahead, F.sum(bad).over(run) == 0).otherwise(False))
    group = Window.partitionBy("robot_id", "at_ms").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    healed = F.last("ok").over(group)  # what follows the last run of that time follows them all
    out = pos.withColumn("healed", F.col("at_ms").isNotNull() & healed)
    return out.where((F.col("status") == "failed") & ~F.col("healed")).select(log.columns)


HEALED = """x as (select r.*, (select count(*) = 2 and count(*) filter (where s.status in ('success', 'completed')) = 2 from
    (select status from runs n where n.robot_id = r.robot_id and n.at_ms > r.at_ms order by n.at_ms, n.run_id limit 2) s) as healed from runs r where status = 'failed')"""
HEAL_LEAD = """x as (select *, lead(status, 1) over w in ('success', 'completed') and lead(status, 2) over w in ('success', 'completed') as h from runs window w as (partition by robot_id order by at_ms, run_id)),
    u as (select * from x where status = 'failed' and not coalesce(h, false))"""


@query(f"with {HEALED} select run_id, robot_id, at_ms, error_message from x where not healed", "runs")
def jn_heal_lookup(spark, d):
    return unhealed(runs(spark, d)).select("run_id", "robot_id", "at_ms", "error_message")


@query("select run_id, robot_id, lead(status, 1) over w as next1, lead(status, 2) over w as next2, coalesce(lead(status, 1) over w in ('success','completed') and lead(status, 2) over w in ('success','completed'), false) as next_two_ok from runs window w as (partition by robot_id order by at_ms, run_id)", "runs")
def win_next_n_all(spark, d):
    w = Window.partitionBy("robot_id").orderBy("at_ms", "run_id")
    r = runs(spark, d).withColumn("next1", F.lead("status", 1).over(w)).withColumn("next2", F.lead("status", 2).over(w))
    return r.select("run_id", "robot_id", "next1", "next2", F.coalesce(F.col("next1").isin(*SUCCESS) & F.col("next2").isin(*SUCCESS), F.lit(False)).alias("next_two_ok"))


def latest(log: DataFrame) -> DataFrame:
    """The last run of each robot."""
    return log.withColumn("nth", F.row_number().over(newest_first())).where("nth = 1").drop("nth")


LATEST_SQL = "latest as (select * from (select *, row_number() over (partition by robot_id order by at_ms desc, run_id desc) as nth from runs) where nth = 1)"


@query(f"with {LATEST_SQL} select robot_id, run_id, status, at_ms, rows_extracted from latest", "runs")
def agg_latest_per_key(spark, d):
    return latest(runs(spark, d)).select("robot_id", "run_id", "status", "at_ms", "rows_extracted")


@query(f"with {LATEST_SQL} select robot_id, run_id, status from latest", "runs")
def win_latest_row(spark, d):
    return latest(runs(spark, d)).select("robot_id", "run_id", "status")


@query(f"with {LATEST_SQL} select robot_id, run_id, status, at_ms, duration_ms from latest", "runs")
def prj_latest_run(spark, d):
    return latest(runs(spark, d)).select("robot_id", "run_id", "status", "at_ms", "duration_ms")


@query(f"with {LATEST_SQL} select sum(rows_extracted)::bigint as total_rows, count(*) filter (where status in ('success','completed')) as succeeded, count(*) filter (where status in ('failed','dead','aborted')) as failed, count(*) as robots from latest", "runs")
def agg_latest_totals(spark, d):
    return latest(runs(spark, d)).agg(F.sum("rows_extracted").alias("total_rows"), F.count_if(F.col("status").isin(*SUCCESS)).alias("succeeded"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"), F.count("*").alias("robots"))


@query("select robot_id, count(*) as n_runs, arg_max(run_id, at_ms) as latest_run, max(at_ms) as latest_ms from runs group by robot_id", "runs")
def agg_run_groups(spark, d):
    return runs(spark, d).groupBy("robot_id").agg(F.count("*").alias("n_runs"), F.max(F.struct("at_ms", "run_id")).alias("x")).select("robot_id", "n_runs", F.col("x.run_id").alias("latest_run"), F.col("x.at_ms").alias("latest_ms"))


@query("select coalesce(status, 'unknown') as status, count(*) as n from runs group by 1", "runs")
def agg_status_counts(spark, d):
    return runs(spark, d).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("select count(*) as n, round(avg(duration_ms)) as avg_ms from runs where duration_ms > 0 and at_ms >= (select max(at_ms) from runs) - 86400000", "runs")
def agg_duration_avg(spark, d):
    r = runs(spark, d)
    now = r.agg(F.max("at_ms").alias("now"))
    return r.where((F.col("duration_ms") > 0) & (F.col("at_ms") >= now.scalar() - 86_400_000)).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms")).alias("avg_ms"))


@query("select robot_id, n, list[least(n - 1, cast(floor(n * 0.95) as bigint)) + 1] as p95_ms from (select robot_id, count(*) as n, list(duration_ms order by duration_ms) as list from runs where duration_ms > 0 group by robot_id)", "runs")
def agg_p95_index(spark, d):
    """Percentile by index min(n - 1, floor(0.95 n)), without collecting a group: ranks and counts are windows."""
    w = Window.partitionBy("robot_id")
    r = runs(spark, d).where("duration_ms > 0").withColumn("n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("duration_ms")) - 1)
    return r.where(F.col("nth") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).select("robot_id", "n", F.col("duration_ms").alias("p95_ms"))


@query("select robot_id, cast(quantile_disc(rows_extracted, 0.5) as bigint) as baseline from runs where rows_extracted > 0 group by robot_id", "runs")
def agg_lower_median(spark, d):
    return runs(spark, d).where("rows_extracted > 0").groupBy("robot_id").agg(F.expr("percentile_disc(0.5) within group (order by rows_extracted)").cast("long").alias("baseline"))


@query("select owner, count(*) as n from robots group by owner", "robots")
def agg_robot_counts(spark, d):
    return robots(spark, d).groupBy("owner").agg(F.count("*").alias("n"))


@query("select l_orderkey, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by l_orderkey")
def agg_extracted_counts(spark, d):
    """Rows per parent, for the parents of a set."""
    lines, parents = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    return lines.join(parents.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def reason_counts(log: DataFrame) -> DataFrame:
    """Failures by reason, unhealed ones only, every code present."""
    codes = log.sparkSession.createDataFrame([(c,) for c in CODES], "reason string")
    found = unhealed(log).groupBy(F.coalesce(failure_reason(F.col("error_message")), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    return codes.join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


_codes = ", ".join(f"('{c}')" for c in CODES)


@query(f"with {HEAL_LEAD}, c as (select coalesce({reason_sql('error_message')}, 'unknown') as reason, count(*) as n from u group by 1) select v.reason, coalesce(n, 0) as n from (values {_codes}) v(reason) left join c using (reason)", "runs")
def agg_reason_counts(spark, d):
    return reason_counts(runs(spark, d))


@query(f"with {HEAL_LEAD}, c as (select coalesce({reason_sql('error_message')}, 'unknown') as reason, count(*) as n from u group by 1) select v.reason, coalesce(n, 0) as n, coalesce(n, 0)::double / nullif(sum(coalesce(n, 0)) over (), 0) as share from (values {_codes}) v(reason) left join c using (reason)", "runs")
def hp_reason_pills(spark, d):
    return reason_counts(runs(spark, d)).withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy())))


@query(f"select run_id, {reason_sql('error_message')} as reason from runs where status = 'failed'", "runs")
def fn_failure_reason(spark, d):
    return runs(spark, d).where("status = 'failed'").select("run_id", failure_reason(F.col("error_message")).alias("reason"))


@query(f"select run_id, coalesce({reason_sql('error_message')}, 'unknown') as reason from runs where status = 'failed' and coalesce({reason_sql('error_message')}, 'unknown') in ('unknown', 'timeout')", "runs")
def flt_reason(spark, d):
    r = runs(spark, d).where("status = 'failed'").select("run_id", F.coalesce(failure_reason(F.col("error_message")), F.lit("unknown")).alias("reason"))
    return r.where(F.col("reason").isin("unknown", "timeout"))


@query(f"select run_id, case when run_id % 13 = 0 then null when run_id % 17 = 0 then 'captcha' else {reason_sql('error_message')} end as reason from runs where status = 'failed'", "runs")
def fn_resolve_reason(spark, d):
    """Precedence: cleared by hand, then a confirmed code, then the classified text."""
    cleared, confirmed = F.col("run_id") % 13 == 0, F.when(F.col("run_id") % 17 == 0, F.lit("captcha"))
    return runs(spark, d).where("status = 'failed'").select("run_id", F.when(~cleared, F.coalesce(confirmed, failure_reason(F.col("error_message")))).alias("reason"))


_source = "case when run_id % 17 = 0 then 'confirmed' when run_id % 5 = 0 then 'suggested' end"


@query(f"""with x as (select run_id, status, rows_extracted, {reason_sql('error_message')} as reason, {_source} as source from runs)
    select run_id, case when s then 'layout_change' else reason end as reason, case when s then 'suggested' else source end as source
    from (select *, rows_extracted = 0 and status in ('failed', 'success') and not (reason is not null and source is not null and source <> 'suggested') as s from x)""", "runs")  # fmt: skip
def fn_layout_suggest(spark, d):
    """Runs without rows suggest a changed layout, unless someone has set the reason: that one is kept."""
    rows = runs(spark, d).select("run_id", "status", "rows_extracted", failure_reason(F.col("error_message")).alias("reason"), F.expr(_source).alias("source"))
    held = F.coalesce(F.col("reason").isNotNull() & (F.col("source") != "suggested"), F.lit(False))
    suggest = (F.col("rows_extracted") == 0) & F.col("status").isin("failed", "success") & ~held
    return rows.select("run_id", F.when(suggest, "layout_change").otherwise(F.col("reason")).alias("reason"), F.when(suggest, "suggested").otherwise(F.col("source")).alias("source"))


# Filters and order


@query("select run_id, at_ms from runs where at_ms >= 1704200000000 and at_ms < 1704300000000", "runs")
def flt_sort_range(spark, d):
    return runs(spark, d).where("at_ms >= 1704200000000 and at_ms < 1704300000000").select("run_id", "at_ms")


@query("select r.run_id from runs r join robots b using (robot_id) where owner = 3 or r.robot_id in (7, 8)", "runs robots")
def flt_owner(spark, d):
    return runs(spark, d).join(robots(spark, d), "robot_id").where((F.col("owner") == 3) | F.col("robot_id").isin(7, 8)).select("run_id")


@query("select r.run_id from runs r join robots b using (robot_id) where (owner = 3 or r.robot_id in (7, 8)) and at_ms between 1704100000000 and 1704400000000", "runs robots")
def flt_owner_window(spark, d):
    r = runs(spark, d).where(F.col("at_ms").between(1704100000000, 1704400000000))
    return r.join(robots(spark, d), "robot_id").where((F.col("owner") == 3) | F.col("robot_id").isin(7, 8)).select("run_id")


@query("select run_id from runs where robot_id in (select robot_id from robots where owner in (1, 2, 3))", "runs robots")
def flt_owner_scope(spark, d):
    return runs(spark, d).join(robots(spark, d).where(F.col("owner").isin(1, 2, 3)), "robot_id", "left_semi").select("run_id")


@query("select run_id from runs where robot_id in (select robot_id from robots where owner is null or owner in (4))", "runs robots")
def hp_owner_filter(spark, d):
    return runs(spark, d).join(robots(spark, d).where("owner is null or owner in (4)"), "robot_id", "left_semi").select("run_id")


@query("select run_id, at_ms from runs where at_ms + 19800000 >= epoch_ms(timestamp '2024-01-03') and at_ms + 19800000 < epoch_ms(timestamp '2024-01-04')", "runs")
def flt_date_query(spark, d):
    """A calendar day of the operations clock (UTC+05:30)."""
    day = 1704240000000  # 2024-01-03
    shifted = F.col("at_ms") + IST_MS
    return runs(spark, d).where((shifted >= day) & (shifted < day + 86_400_000)).select("run_id", "at_ms")


DURATION_SQL = f"""dur as (select *, case when lower(coalesce(status, '')) in ('running','pending','queued') then null else
    case when coalesce(case when regexp_matches(finished_at, '^[0-9]{{4}}-') then at_ms - started_ms end, case when duration_ms > 0 then duration_ms end) between 0 and {SANE_MS}
    then coalesce(case when regexp_matches(finished_at, '^[0-9]{{4}}-') then at_ms - started_ms end, case when duration_ms > 0 then duration_ms end) end end as resolved from runs)"""


def resolved(log: DataFrame) -> DataFrame:
    """Adds `resolved`: finish less start where the finish is ISO text, else the stored duration if positive; null for active runs and outside 0 to 48 hours."""
    between = F.when(F.col("finished_at").rlike("^[0-9]{4}-"), F.col("at_ms") - F.col("started_ms"))
    raw = F.coalesce(between, F.when(F.col("duration_ms") > 0, F.col("duration_ms")))
    return log.withColumn("resolved", F.when(F.lower(F.coalesce("status", F.lit(""))).isin(*ACTIVE), None).when(raw.between(0, SANE_MS), raw))


@query(f"with {DURATION_SQL} select run_id, resolved from dur", "runs")
def dt_duration(spark, d):
    return resolved(runs(spark, d)).select("run_id", "resolved")


@query(f"with {DURATION_SQL} select run_id, resolved from dur where resolved between 5000 and 40000", "runs")
def flt_duration_range(spark, d):
    return resolved(runs(spark, d)).where("resolved between 5000 and 40000").select("run_id", "resolved")


@query("with recursive m as (select r.*, name, company from runs r join robots using (robot_id)) select run_id, robot_id, rows_extracted from m where (contains(lower(name), '1') or contains(lower(company), 'build')) and status in ('failed','aborted') and jobs_added between 1 and 5".replace("with recursive", "with"), "runs robots")
def flt_runs_params(spark, d):
    """Runs by parameters: text over the robot's name and company, states, added jobs."""
    found = robots(spark, d).where(F.lower("name").contains("1") | F.lower("company").contains("build")).select("robot_id")
    return runs(spark, d).where(F.col("status").isin("failed", "aborted") & F.col("jobs_added").between(1, 5)).join(found, "robot_id", "left_semi").select("run_id", "robot_id", "rows_extracted")


@query("select run_id from runs where contains(lower(coalesce(error_message, '')), 'closed') and robot_id in (select robot_id from robots where name like 'Customer#%1%')", "runs robots")
def flt_admin_q(spark, d):
    own = robots(spark, d).where("name like 'Customer#%1%'").select("robot_id")
    return runs(spark, d).where(F.lower(F.coalesce("error_message", F.lit(""))).contains("closed")).join(own, "robot_id", "left_semi").select("run_id")


@query("select run_id from runs where robot_id in (select robot_id from robots where contains(lower(company), 'auto'))", "runs robots")
def jn_q_semi(spark, d):
    return runs(spark, d).join(robots(spark, d).where(F.lower("company").contains("auto")), "robot_id", "left_semi").select("run_id")


@query("select run_id from runs where robot_id in (select robot_id from robots where owner in (select n_nationkey from nation where n_regionkey = 1))", "runs robots")
def jn_owner_semi(spark, d):
    own = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("owner"))
    return runs(spark, d).join(robots(spark, d).join(own, "owner", "left_semi"), "robot_id", "left_semi").select("run_id")


@query("select run_id, status, rank from (select run_id, status, row_number() over (order by at_ms desc, run_id desc) as rank from runs) where rank <= 100", "runs")
def srt_run_list(spark, d):
    """The first 100 of the run list: top-k first, so that the rank sees 100 rows."""
    top = runs(spark, d).orderBy(F.desc("at_ms"), F.desc("run_id")).limit(100)
    return top.select("run_id", "status", F.row_number().over(Window.orderBy(F.desc("at_ms"), F.desc("run_id"))).alias("rank"))


@query("select run_id, total from (select run_id, row_number() over (order by at_ms desc, run_id desc) as rank, count(*) over () as total from runs where status = 'failed') where rank between 21 and 40", "runs")
def lim_page(spark, d):
    """Page 2 of 20, with the total."""
    f = runs(spark, d).where("status = 'failed'")
    page = f.orderBy(F.desc("at_ms"), F.desc("run_id")).offset(20).limit(20)
    return page.select("run_id", f.agg(F.count("*")).scalar().alias("total"))


@query("select run_id, total from (select run_id, row_number() over (order by at_ms desc, run_id desc) as rank, count(*) over () as total from runs where status = 'failed') where rank <= 25", "runs")
def agg_facet_page_total(spark, d):
    f = runs(spark, d).where("status = 'failed'")
    return f.orderBy(F.desc("at_ms"), F.desc("run_id")).limit(25).select("run_id", f.agg(F.count("*")).scalar().alias("total"))


@query("select run_id, at_ms from (select *, row_number() over (order by at_ms, run_id) as k from runs where (at_ms, run_id) > (1704200000000, 500)) where k <= 51", "runs")
def win_pagination_keyset(spark, d):
    """The 50 rows after a cursor, and one more that shows whether there are others."""
    after = (F.col("at_ms") > 1704200000000) | ((F.col("at_ms") == 1704200000000) & (F.col("run_id") > 500))
    return runs(spark, d).where(after).orderBy("at_ms", "run_id").limit(51).select("run_id", "at_ms")


@query("select robot_id, max(at_ms) as latest_ms, count(*) as n from runs group by robot_id order by latest_ms desc, robot_id desc limit 30", "runs")
def srt_groups(spark, d):
    return runs(spark, d).groupBy("robot_id").agg(F.max("at_ms").alias("latest_ms"), F.count("*").alias("n")).orderBy(F.desc("latest_ms"), F.desc("robot_id")).limit(30)


@query("select robot_id, count(*) as n from runs where status = 'failed' group by robot_id order by n desc, robot_id limit 5", "runs")
def lim_topk(spark, d):
    return runs(spark, d).where("status = 'failed'").groupBy("robot_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "robot_id").limit(5)


@query("select robot_id, count(*) as n, arg_max(error_message, at_ms) filter (where error_message is not null) as last_error from runs where status = 'failed' group by robot_id order by n desc, robot_id limit 5", "runs")
def agg_top_failures(spark, d):
    return runs(spark, d).where("status = 'failed'").groupBy("robot_id").agg(F.count("*").alias("n"), F.max_by("error_message", F.when(F.col("error_message").isNotNull(), F.col("at_ms"))).alias("last_error")).orderBy(F.desc("n"), "robot_id").limit(5)


@query("select count(*) as n from runs where status = 'failed' and rows_extracted > 3", "runs")
def agg_count(spark, d):
    return runs(spark, d).where("status = 'failed' and rows_extracted > 3").agg(F.count("*").alias("n"))


@query("select distinct status from runs", "runs")
def agg_distinct(spark, d):
    return runs(spark, d).select("status").distinct()


# Joins


@query("select run_id, coalesce(name, 'Unknown automation') as name, coalesce(company, '') as company from runs left join robots using (robot_id)", "runs robots")
def jn_robot_hydrate(spark, d):
    return runs(spark, d).join(robots(spark, d), "robot_id", "left").select("run_id", F.coalesce("name", F.lit("Unknown automation")).alias("name"), F.coalesce("company", F.lit("")).alias("company"))


@query("select g.robot_id, n, coalesce(name, 'Unknown automation') as name from (select robot_id, count(*) as n from runs group by robot_id) g left join robots using (robot_id)", "runs robots")
def jn_group_hydrate(spark, d):
    return runs(spark, d).groupBy("robot_id").agg(F.count("*").alias("n")).join(robots(spark, d), "robot_id", "left").select("robot_id", "n", F.coalesce("name", F.lit("Unknown automation")).alias("name"))


@query("select r.run_id, b.name, n_name as owner_name, c.n as robot_runs from runs r left join robots b using (robot_id) left join nation on n_nationkey = b.owner left join (select robot_id, count(*) as n from runs group by 1) c on c.robot_id = r.robot_id where r.status = 'failed'", "runs robots")
def jn_admin_owner(spark, d):
    r = runs(spark, d)
    owners = F.broadcast(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("owner"), F.col("n_name").alias("owner_name")))
    return r.where("status = 'failed'").join(robots(spark, d), "robot_id", "left").join(owners, "owner", "left").join(r.groupBy("robot_id").agg(F.count("*").alias("robot_runs")), "robot_id", "left").select("run_id", "name", "owner_name", "robot_runs")


@query("select coalesce(u.k, c.owner) as owner, coalesce(n, 0) as robots, u.k is null as orphan from (select cast(n_nationkey as bigint) as k from nation where n_nationkey < 20) u full outer join (select owner, count(*) as n from robots group by owner) c on u.k = c.owner", "robots")
def jn_users_full(spark, d):
    """Owners with their robots, and owners of robots that no user row has."""
    users = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("k"))
    counts = robots(spark, d).groupBy("owner").agg(F.count("*").alias("n"))
    return users.join(counts, users.k == counts.owner, "full_outer").select(F.coalesce("k", "owner").alias("owner"), F.coalesce("n", F.lit(0)).alias("robots"), F.col("k").isNull().alias("orphan"))


@query("select tag, count(*) as runs, sum(jobs_added)::bigint as jobs_added from (select unnest(tags) as tag, jobs_added from runs join robots using (robot_id)) group by tag", "runs robots")
def jn_tag_explode(spark, d):
    """Runs are summed per robot before tags multiply them."""
    own = runs(spark, d).groupBy("robot_id").agg(F.count("*").alias("runs"), F.sum("jobs_added").alias("jobs_added"))
    return own.join(robots(spark, d), "robot_id").select(F.explode("tags").alias("tag"), "runs", "jobs_added").groupBy("tag").agg(F.sum("runs").alias("runs"), F.sum("jobs_added").alias("jobs_added"))


@query("with t as (select tag, count(*) as runs, sum(jobs_added)::bigint as jobs_added from (select unnest(tags) as tag, jobs_added from runs join robots using (robot_id)) group by tag) select c.tag, coalesce(runs, 0) as runs, coalesce(jobs_added, 0) as jobs_added from (select 'nation:' || n_name as tag from nation union all values ('segment:NONE')) c left join t using (tag)", "runs robots")
def jn_catalog_left(spark, d):
    catalog = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("nation:"), "n_name").alias("tag")).union(spark.createDataFrame([("segment:NONE",)], "tag string"))
    return catalog.join(jn_tag_explode(spark, d), "tag", "left").na.fill(0, ["runs", "jobs_added"])


@query("with recursive w as (select run_id, run_id as root, 0::bigint as depth from runs where retry_of is null union all select r.run_id, w.root, w.depth + 1 from runs r join w on r.retry_of = w.run_id) select run_id, root, depth from w", "runs")
def jn_retry_lineage(spark, d):
    """Root and place in the chain of retries."""
    return lineage(runs(spark, d).select("run_id", "retry_of"))


def lineage(log: DataFrame) -> DataFrame:
    """run_id, retry_of -> run_id, root, depth, by pointer doubling: each round doubles the links that are behind a run, until every pointer is at a run that retries none.

    Rounds are written to the shared folder. A retry of a run that is not there, or of itself over others, has no root and no row: such are left
    when a round changes nothing any more.
    """
    def kept(df: DataFrame) -> DataFrame:
        path = fresh_path(df.sparkSession, "lineage")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    now = kept(log.select("run_id", F.coalesce("retry_of", "run_id").alias("root"), F.when(F.col("retry_of").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    rounds = now.count().bit_length() + 1  # a chain without a loop ends within these
    for _ in range(rounds):
        up = now.select(F.col("run_id").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        joined = now.join(up, "root")
        if joined.where("depth2 > 0").isEmpty():
            break
        now = kept(joined.select("run_id", F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth")))
    ends = log.where("retry_of is null").select(F.col("run_id").alias("root"))
    return now.join(ends, "root", "left_semi").select("run_id", "root", "depth")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 5)")
def jn_cascade_delete(spark, d):
    """What is left of a table after its parents went."""
    gone = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"))
    return spark.read.parquet(f"{d}/orders.parquet").join(gone, "o_custkey", "left_anti").select("o_orderkey")


# Rollups and windows


@query("select count(*) as runs, count(*) filter (where status in ('success','completed')) as passed, count(*) filter (where status in ('failed','dead','aborted')) as failed, count(*) filter (where status in ('running','pending','queued')) as running, sum(rows_extracted)::bigint as rows_extracted, sum(jobs_added)::bigint as jobs_added from runs where at_ms between 1704100000000 and 1704400000000", "runs")
def agg_ops_rollup(spark, d):
    s = F.col("status")
    return runs(spark, d).where("at_ms between 1704100000000 and 1704400000000").agg(F.count("*").alias("runs"), F.count_if(s.isin(*SUCCESS)).alias("passed"), F.count_if(s.isin(*FAILED)).alias("failed"), F.count_if(s.isin(*ACTIVE)).alias("running"), F.sum("rows_extracted").alias("rows_extracted"), F.sum("jobs_added").alias("jobs_added"))


@query("with b as (select max(at_ms) as now from runs), g as (select now, (now + 19800000) // 10800000 * 10800000 - 19800000 - 7 * 10800000 as since from b) select i, since + i * 10800000 as bucket_ms, count(run_id) as total from g cross join range(8) t(i) left join runs on at_ms >= since + i * 10800000 and at_ms < case when i = 7 then now + 1 else since + (i + 1) * 10800000 end group by 1, 2", "runs")
def dt_bucket_index(spark, d):
    """The eight buckets of the last 24 hours by arithmetic on the time, not by a join; the last one ends now."""
    r, unit = runs(spark, d), 10_800_000
    now = r.agg(F.max("at_ms")).scalar()
    since = F.floor((now + IST_MS) / unit) * unit - IST_MS - 7 * unit
    found = r.where((F.col("at_ms") >= since) & (F.col("at_ms") <= now)).groupBy(F.floor((F.col("at_ms") - since) / unit).alias("i")).agg(F.count("*").alias("total"))
    return spark.range(8).withColumnRenamed("id", "i").join(found, "i", "left").select("i", (since + F.col("i") * unit).alias("bucket_ms"), F.coalesce("total", F.lit(0)).alias("total"))


@query("with b as (select max(at_ms) as now from runs) select (now + 19800000) // u * u - 19800000 - (n - 1) * u as since_ms, now as until_ms, w from b cross join (values ('15m', 180000, 5), ('30m', 300000, 6), ('1h', 600000, 6), ('3h', 1800000, 6), ('6h', 3600000, 6), ('24h', 10800000, 8)) t(w, u, n)", "runs")
def dt_ops_bounds(spark, d):
    #: Bucket length in ms and number of buckets of each window.
    kinds = spark.createDataFrame([("15m", 180_000, 5), ("30m", 300_000, 6), ("1h", 600_000, 6), ("3h", 1_800_000, 6), ("6h", 3_600_000, 6), ("24h", 10_800_000, 8)], "w string, u long, n long")
    now = runs(spark, d).agg(F.max("at_ms")).scalar()
    return kinds.select((F.floor((now + IST_MS) / F.col("u")) * F.col("u") - IST_MS - (F.col("n") - 1) * F.col("u")).alias("since_ms"), now.alias("until_ms"), "w")


@query("select run_id, strftime(make_timestamp((at_ms + 19800000) * 1000), '%Y-%m-%d') as ist_day, ((at_ms + 19800000) // 3600000) % 24 as ist_hour, ((at_ms + 19800000) // 60000) % 60 as ist_minute, (at_ms + 19800000) // 86400000 * 86400000 - 19800000 as day_start_ms, ((at_ms + 19800000) // 86400000 + 1) * 86400000 - 19800001 as day_end_ms from runs", "runs")
def dt_ist_day(spark, d):
    s = F.col("at_ms") + IST_MS
    day = F.floor(s / 86_400_000)
    return runs(spark, d).select("run_id", F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string").alias("ist_day"), (F.floor(s / 3_600_000) % 24).alias("ist_hour"), (F.floor(s / 60_000) % 60).alias("ist_minute"), (day * 86_400_000 - IST_MS).alias("day_start_ms"), ((day + 1) * 86_400_000 - IST_MS - 1).alias("day_end_ms"))


@query("select ((at_ms + 19800000) // 3600000) % 24 as ist_hour, count(*) as n from runs group by 1", "runs")
def dt_ist_hour(spark, d):
    return runs(spark, d).groupBy((F.floor((F.col("at_ms") + IST_MS) / 3_600_000) % 24).alias("ist_hour")).agg(F.count("*").alias("n"))


@query("select run_id, (at_ms + 19800000) // 600000 * 600000 - 19800000 as floor_ms from runs", "runs")
def dt_ist_floor(spark, d):
    return runs(spark, d).select("run_id", (F.floor((F.col("at_ms") + IST_MS) / 600_000) * 600_000 - IST_MS).alias("floor_ms"))


@query("select h.h as hour, count(run_id) as fires from range(24) h(h) left join runs on ((at_ms + 19800000) // 3600000) % 24 = h.h group by 1", "runs")
def agg_hour_histogram(spark, d):
    found = runs(spark, d).groupBy((F.floor((F.col("at_ms") + IST_MS) / 3_600_000) % 24).alias("hour")).agg(F.count("*").alias("fires"))
    return spark.range(24).withColumnRenamed("id", "hour").join(found, "hour", "left").na.fill(0, ["fires"])


@query("with w as (select 6 as h union all select 24), r as (select w.h, x.* from w join runs x on x.at_ms > (select max(at_ms) from runs) - w.h * 3600000) select h as hours, count(*) as runs, count(*) filter (where status in ('success','completed')) as passed, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'aborted') as aborted, count(*) filter (where retry_of is not null) as retries, round(100.0 * count(*) filter (where status in ('success','completed')) / nullif(count(*) filter (where status <> 'running'), 0)) as pass_rate from r group by h", "runs")
def agg_window_stats(spark, d):
    r = runs(spark, d)
    now = r.agg(F.max("at_ms")).scalar()
    hours = F.explode(F.array(*[F.when(F.col("at_ms") > now - h * 3_600_000, F.lit(h)) for h in (6, 24)]))
    s = F.col("status")
    passed, done = F.count_if(s.isin(*SUCCESS)), F.count_if(s != "running")
    return r.where(F.col("at_ms") > now - 86_400_000).withColumn("hours", hours).where("hours is not null").groupBy("hours").agg(F.count("*").alias("runs"), passed.alias("passed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "aborted").alias("aborted"), F.count_if(F.col("retry_of").isNotNull()).alias("retries"), F.round(F.try_divide(passed * 100.0, done)).alias("pass_rate"))


@query("select robot_id, round(100.0 * count(*) filter (where status in ('success','completed')) / nullif(count(*) filter (where status <> 'running'), 0)) as pass_rate from runs group by robot_id", "runs")
def agg_pass_rate(spark, d):
    s = F.col("status")
    return runs(spark, d).groupBy("robot_id").agg(F.round(F.try_divide(F.count_if(s.isin(*SUCCESS)) * 100.0, F.count_if(s != "running"))).alias("pass_rate"))


DRIFT_SQL = """good as (select *, row_number() over (partition by robot_id order by run_id) as g from runs where status in ('success','completed') and rows_extracted > 0),
    base as (select r.run_id, r.robot_id, r.rows_extracted, (select quantile_disc(x.rows_extracted, 0.5) from (select g.rows_extracted from good g where g.robot_id = r.robot_id and g.run_id < r.run_id order by g.run_id desc limit 5) x) as baseline from runs r where r.status in ('success','completed')),
    drift as (select *, case when rows_extracted = 0 then 'zero_rows' when baseline is null or baseline < 5 then 'healthy' when rows_extracted >= floor(baseline * 0.5) then 'healthy' else 'drop' end as kind from base),
    since as (select *, count(*) filter (where kind <> 'drop') over (partition by robot_id order by run_id) as island from drift),
    streak as (select *, case when kind <> 'drop' then kind when count(*) filter (where kind = 'drop') over (partition by robot_id, island order by run_id) % 3 = 0 then 'escalated' else 'soft_drop' end as outcome from since)"""


def baselines(log: DataFrame, back: int = 5) -> DataFrame:
    """Finished runs with the lower median of the rows of the last `back` good runs before each: good runs are collected over a frame of fixed width."""
    done = log.where(F.col("status").isin(*SUCCESS))
    w = Window.partitionBy("robot_id").orderBy("run_id")
    good = F.when(F.col("rows_extracted") > 0, F.col("rows_extracted"))
    # numbers good runs, so that the frame over them has a fixed width
    nth = F.count(good).over(w.rowsBetween(Window.unboundedPreceding, -1))
    done = done.withColumn("nth", nth)
    frame = Window.partitionBy("robot_id").orderBy("nth").rangeBetween(-back, -1)
    values = F.array_sort(F.collect_list(good).over(frame))
    return done.withColumn("recent", values).withColumn("baseline", F.try_element_at("recent", F.greatest(F.lit(1), F.floor((F.size("recent") + 1) / 2).cast("int")))).drop("recent", "nth")


def drift(log: DataFrame, ratio: float = 0.5, least: int = 5, streak: int = 3) -> DataFrame:
    """outcome of each finished run: healthy, zero_rows, soft_drop, or escalated: a drop after `streak` - 1 soft ones. An escalated drop is no soft one: a row of drops escalates once in `streak`."""
    kind = F.when(F.col("rows_extracted") == 0, "zero_rows").when(F.col("baseline").isNull() | (F.col("baseline") < least), "healthy").when(F.col("rows_extracted") >= F.floor(F.col("baseline") * ratio), "healthy").otherwise("drop")
    w = Window.partitionBy("robot_id").orderBy("run_id")
    rows = baselines(log).withColumn("kind", kind).withColumn("island", F.count_if(F.col("kind") != "drop").over(w))
    nth = F.count_if(F.col("kind") == "drop").over(Window.partitionBy("robot_id", "island").orderBy("run_id"))
    return rows.withColumn("outcome", F.when(F.col("kind") != "drop", F.col("kind")).when(nth % streak == 0, "escalated").otherwise("soft_drop"))


@query(f"with {DRIFT_SQL} select run_id, baseline from base", "runs")
def win_baseline_last5(spark, d):
    return baselines(runs(spark, d)).select("run_id", "baseline")


@query(f"with {DRIFT_SQL} select run_id, rows_extracted, baseline, outcome from streak", "runs")
def win_drift(spark, d):
    return drift(runs(spark, d)).select("run_id", "rows_extracted", "baseline", "outcome")


@query(f"with {DRIFT_SQL} select run_id, outcome = 'escalated' as two_drops_before from streak where kind = 'drop'", "runs")
def win_prior_streak(spark, d):
    return drift(runs(spark, d)).where("kind = 'drop'").select("run_id", (F.col("outcome") == "escalated").alias("two_drops_before"))


@query("select run_id, case when lower(status) in ('success','completed') then 'completed' when lower(status) in ('failed','running','aborted') then lower(status) else 'idle' end as shown from runs", "runs")
def prj_status_map(spark, d):
    s = F.lower("status")
    return runs(spark, d).select("run_id", F.when(s.isin(*SUCCESS), "completed").when(s.isin("failed", "running", "aborted"), s).otherwise("idle").alias("shown"))


@query("select run_id, robot_id, status, at_ms, rows_extracted, jobs_added, finished_at from runs", "runs")
def prj_run_list(spark, d):
    return runs(spark, d).select("run_id", "robot_id", "status", "at_ms", "rows_extracted", "jobs_added", "finished_at")


@query(f"with {DURATION_SQL} select run_id, coalesce(name, 'Unknown automation') as name, resolved, {reason_sql('error_message')} as reason, coalesce(rows_extracted, 0) as rows_extracted from dur left join robots using (robot_id)", "runs robots")
def prj_run_enrich(spark, d):
    r = resolved(runs(spark, d)).join(robots(spark, d), "robot_id", "left")
    return r.select("run_id", F.coalesce("name", F.lit("Unknown automation")).alias("name"), "resolved", failure_reason(F.col("error_message")).alias("reason"), F.coalesce("rows_extracted", F.lit(0)).alias("rows_extracted"))


@query("select run_id, case when regexp_matches(finished_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]{3})?Z$') then finished_at end as finished_iso from runs", "runs")
def dt_iso_only(spark, d):
    return runs(spark, d).select("run_id", F.when(F.col("finished_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"), F.col("finished_at")).alias("finished_iso"))


@query("select run_id, coalesce(regexp_matches(finished_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T'), false) as canonical from runs", "runs")
def hp_ts_canonical(spark, d):
    return runs(spark, d).select("run_id", F.coalesce(F.col("finished_at").rlike(r"^\d{4}-\d{2}-\d{2}T"), F.lit(False)).alias("canonical"))


@query("select run_id, case when run_id % 4 = 0 then started_ms else at_ms end as list_ms from runs", "runs")
def dt_list_sort_at(spark, d):
    """First of finish, stored time and start; the finish and stored time are missing for every fourth run here."""
    stored = F.when(F.col("run_id") % 4 != 0, F.col("at_ms"))
    return runs(spark, d).select("run_id", F.coalesce(stored, "started_ms").alias("list_ms"))


@query("select run_id, case when run_id % 3 = 0 then greatest(at_ms - 5, started_ms) else at_ms end as run_ms from runs", "runs")
def dt_run_ts(spark, d):
    stored = F.when(F.col("run_id") % 3 != 0, F.col("at_ms"))
    return runs(spark, d).select("run_id", F.coalesce(stored, F.greatest(F.col("at_ms") - 5, "started_ms")).alias("run_ms"))


@query("select run_id, n_at - started_ms as elapsed_ms from (select *, (select max(at_ms) from runs) as n_at from runs where status = 'running')", "runs")
def hp_elapsed(spark, d):
    r = runs(spark, d)
    return r.where("status = 'running'").select("run_id", (r.agg(F.max("at_ms")).scalar() - F.col("started_ms")).alias("elapsed_ms"))


@query("select run_id from (select *, (select max(at_ms) from runs) as n_at from runs where status = 'running') where n_at - started_ms > 86400000 order by started_ms, run_id limit 40", "runs")
def hp_stale_pending(spark, d):
    r = runs(spark, d)
    return r.where((F.col("status") == "running") & (r.agg(F.max("at_ms")).scalar() - F.col("started_ms") > 86_400_000)).orderBy("started_ms", "run_id").limit(40).select("run_id")


@query("select run_id, case when resolved is null then '—' when resolved < 1000 then resolved || 'ms' when resolved < 60000 then (resolved // 1000) || 's' else (resolved // 60000) || 'm ' || (resolved // 1000 % 60) || 's' end as shown from dur".replace("select run_id", f"with {DURATION_SQL} select run_id", 1), "runs")
def hp_duration_fmt(spark, d):
    r, s = F.col("resolved"), F.floor(F.col("resolved") / 1000)
    return resolved(runs(spark, d)).select("run_id", F.when(r.isNull(), "—").when(r < 1000, F.concat(r.cast("string"), F.lit("ms"))).when(r < 60_000, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(r / 60_000).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).alias("shown"))


@query("select status, count(*) as n from runs where status in ('running') group by status union all select 'slots', count(distinct robot_id) from runs where status = 'running'", "runs")
def agg_active_slots(spark, d):
    a = runs(spark, d).where("status = 'running'")
    return a.groupBy("status").agg(F.count("*").alias("n")).union(a.agg(F.lit("slots"), F.count_distinct("robot_id")))


@query("select robot_id from robots b where not exists (select 1 from runs r where r.robot_id = b.robot_id and r.status = 'running' and at_ms > (select max(at_ms) from runs) - 86400000) order by robot_id limit 40", "runs robots")
def st_missed_sweep(spark, d):
    r = runs(spark, d)
    busy = r.where((F.col("status") == "running") & (F.col("at_ms") > r.agg(F.max("at_ms")).scalar() - 86_400_000))
    return robots(spark, d).join(busy, "robot_id", "left_anti").select("robot_id").orderBy("robot_id").limit(40)


@query("select run_id from (select *, row_number() over (partition by robot_id order by at_ms, run_id) as k from runs where status = 'running') where k = 1", "runs")
def st_admission(spark, d):
    """One active run per robot: the first one is let in."""
    w = Window.partitionBy("robot_id").orderBy("at_ms", "run_id")
    return runs(spark, d).where("status = 'running'").withColumn("k", F.row_number().over(w)).where("k = 1").select("run_id")
