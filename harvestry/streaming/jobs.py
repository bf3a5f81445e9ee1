"""The polling loops as Structured Streaming jobs: they read what is there, keep their state in checkpoints and stop.

A job that is started again goes on after the last batch that it committed. Stateful operators hold a few
numbers for each key; the rows of a key that one batch brings are put in order before they are applied, so
`maxFilesPerTrigger` bounds what a task holds.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harvestry.plans.views import at_ms, runs, table
from harvestry.registry import query
from harvestry.sources.storage import fresh_path

HOUR, DAY = 3_600_000, 86_400_000
NOW_MS = 1705000000000


def arriving(spark: SparkSession, d: str, files: int = 8) -> DataFrame:
    """The events as a stream of files: run_id, robot_id, status, at_ms, value. The path is a pattern, as a stream takes a plain one for a folder."""
    kind = table(spark, d, "events").schema
    status = F.expr("case event_type when 'error' then 'failed' when 'click' then 'aborted' when 'purchase' then 'success' when 'signup' then 'completed' when 'view' then 'running' end")
    e = spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(f"{d}/[e]vents.parquet")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("robot_id"), status.alias("status"), at_ms("ts").alias("at_ms"), F.col("ts").cast("timestamp").alias("ts"), "value")


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table at `path` with its checkpoint beside, and read the table."""
    if mode == "complete":
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
    writer.option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query("select run_id, status, at_ms, status = 'failed' as failed from runs", "runs")
def src_resumable_scan(spark, d):
    """A scan that can be stopped: a second start finds nothing left to do and writes nothing again."""
    path = fresh_path(spark, "stream-scan")
    scan = lambda: arriving(spark, d, 1).select("run_id", "status", "at_ms", (F.col("status") == "failed").alias("failed"))
    drained(scan(), path)
    return drained(scan(), path)


@query("select (at_ms - 1800000) // 3600000 * 3600000 + 1800000 as hour_ms, count(*) as n, count(*) filter (where status = 'failed') as failed from runs group by 1", "runs")
def st_tumbling_ops(spark, d):
    """Runs and failures by hours that begin at half past, with a watermark; all windows are given at the end."""
    w = F.window("ts", "1 hour", "1 hour", "30 minutes")
    counts = arriving(spark, d).withWatermark("ts", "1 day").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    out = drained(counts.select(F.unix_millis("w.start").alias("hour_ms"), "n", "failed"), fresh_path(spark, "stream-hours"), "complete")
    return out.select("hour_ms", "n", "failed")


@query("select at_ms // 86400000 as day, count(*) as calls, sum(cast(floor(value) as bigint)) as used, sum(cast(floor(value) as bigint)) >= 1000 as paused from (select epoch_us(ts) // 1000 as at_ms, value from events) group by 1")
def st_daily_budget(spark, d):
    """Counters of each UTC day, kept as batches come, and whether its budget is used up."""
    used = F.sum(F.floor("value").cast("long"))
    counts = arriving(spark, d).groupBy(F.floor(F.col("at_ms") / DAY).alias("day")).agg(F.count("*").alias("calls"), used.alias("used"), (used >= 1000).alias("paused"))
    return drained(counts, fresh_path(spark, "stream-budget"), "complete")


@query("select robot_id, count(*) as n, count(*) filter (where status in ('success', 'completed')) as ok, max(at_ms) as last_ms from runs group by robot_id", "runs")
def st_run_terminal(spark, d):
    """Each robot's ended runs so far: what a terminal update releases and counts."""
    counts = arriving(spark, d).groupBy("robot_id").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("success", "completed")).alias("ok"), F.max("at_ms").alias("last_ms"))
    return drained(counts, fresh_path(spark, "stream-terminal"), "complete")


# Folds with a state for each key


#: A host's breaker: failures in a window that open it, the window, and how long it stays open. The service's own numbers are 5, two minutes and ten minutes.
FAILURES, WINDOW_MS, COOL_MS = 3, 10 * DAY, 1 * DAY


def breaker(state: list, status: str, at: int, rows: int, failures: int = FAILURES, window: int = WINDOW_MS, cool: int = COOL_MS) -> tuple[list, str]:
    """[failures, window's start, open until]: a failure counts, open or not, and opens the breaker as the last of `failures` within a window; a success takes one back and leaves the window as it is."""
    n, since, until = state or [0, at, 0]
    if status == "failed":
        if at - since > window:
            n, since = 0, at
        n += 1
        if n >= failures:
            return [0, at, at + cool], "opened"
    elif status in ("success", "completed"):
        n = max(0, n - 1)
    return [n, since, until], "open" if at < until else "closed"


#: Failures of a host, all in all, that raise its tier, the dearest tier, and when a lower one is tried again.
RAISE, MOST_TIER, AGAIN_MS = 3, 3, 30 * DAY


def tier(state: list, status: str, at: int, rows: int, raised_by: int = RAISE, most: int = MOST_TIER, again: int = AGAIN_MS) -> tuple[list, str]:
    """[tier, failures, last success]: a run uses the learned tier, or the one below if the last success is longer ago than `again` or there was none. A success stores the tier that worked (`completed`: the next dearer one); a failure is counted for good, stores the tier that was tried and, from the third on, the next."""
    learned, failures, success = state or [1, 0, -1]
    used = learned - 1 if learned > 1 and (success < 0 or at - success > again) else learned
    if status == "failed":
        failures += 1
        return [min(most, used + 1) if failures >= raised_by else used, failures, success], str(used)
    if status in ("success", "completed"):
        return [min(most, used + (status == "completed")), failures, at], str(used)
    return [learned, failures, success], str(used)


#: Attempts before a listing counts as failed, and how long a claim holds.
ATTEMPTS, LEASE_MS = 4, 15 * 60_000


def listing_state(state: list, status: str, at: int, rows: int) -> tuple[list, str]:
    """[state, attempts, lease until] of a listing after an event: queued -> enriching -> ready, partial or, after ATTEMPTS, failed. A claim whose lease has run out is queued again first."""
    now, attempts, lease = state or ["queued", 0, 0]
    if now == "enriching" and lease < at:
        now = "queued"
    if status == "running" and now in ("queued", "partial"):
        now, lease, attempts = "enriching", at + LEASE_MS, attempts + 1
    elif status in ("success", "completed") and now == "enriching":
        now = "ready" if status == "success" else "partial"
    elif status == "failed" and now == "enriching":
        now = "failed" if attempts >= ATTEMPTS else "queued"
    elif status == "aborted" and now in ("queued", "partial"):
        now = "expired"
    return [now, attempts, lease], now


#: A run drifts if its rows are under this part of the baseline, which must be so many rows; a row of drops escalates at the third.
DROP_RATIO, LEAST_BASELINE, STREAK, GOOD_RUNS = 0.5, 5, 3, 5


def drift(state: list, status: str, at: int, rows: int) -> tuple[list, str]:
    """[rows of the last good runs, drops in a row] and the outcome of a finished run against the lower median of those rows."""
    good, drops = state or [[], 0]
    if status not in ("success", "completed"):
        return [good, drops], "unfinished"
    baseline = sorted(good)[(len(good) - 1) // 2] if good else None
    kind = "zero_rows" if rows == 0 else "healthy" if baseline is None or baseline < LEAST_BASELINE or rows >= int(baseline * DROP_RATIO) else "drop"
    drops = drops + 1 if kind == "drop" else 0
    outcome = kind if kind != "drop" else "escalated" if drops % STREAK == 0 else "soft_drop"
    return [[*good, rows][-GOOD_RUNS:] if rows > 0 else good, drops], outcome


#: Runs a minute that a robot may start, and how many at once after a rest.
RATE_PER_MIN, CAPACITY = 1 / 720, 2.0


def bucket(state: list, status: str, at: int, rows: int, rate: float = RATE_PER_MIN, capacity: float = CAPACITY) -> tuple[list, str]:
    """[tokens, last refill]: each run takes a token if there is a whole one, after what the time since has added."""
    tokens, last = state or [capacity, at]
    tokens, last = (min(capacity, tokens + (at - last) / 60_000 * rate), at) if at > last else (tokens, last)
    return [tokens - 1 if tokens >= 1 else tokens, last], "taken" if tokens >= 1 else "refused"


FOLDS = {"st_circuit_breaker": breaker, "st_tier_learning": tier, "st_status_machine": listing_state, "st_drift_stream": drift, "st_token_bucket": bucket}
#: The runs of each robot in order, numbered: what the twins walk over.
WALK = "e as (select run_id, robot_id, status, at_ms, coalesce(rows_extracted, 0) as rows, row_number() over (partition by robot_id order by at_ms, run_id) as i from runs where robot_id is not null and at_ms is not null)"
OK = "e.status in ('success', 'completed')"


def walked(columns: str, start: str, step: str, outcome: str, before: str = "") -> str:
    """SQL of a fold: `start` is the state before a robot's first run (over e), `step` the state after a run (over w and e); a walk of one run at a time."""
    names = columns.split()
    pairs = lambda text: ", ".join(f"{x} as {n}" for n, x in zip(names, text.split(" | "), strict=True))
    first = f"select e.robot_id, e.run_id, e.i, {{}} from e join (select robot_id, {pairs(start)} from e where i = 1) w on w.robot_id = e.robot_id where e.i = 1"
    then = "select e.robot_id, e.run_id, e.i, {} from w join e on e.robot_id = w.robot_id and e.i = w.i + 1"
    body = f"{pairs(step)}, {outcome} as outcome"
    return f"with recursive {WALK}, w as ({first.format(body)} union all {then.format(body)}) select run_id, robot_id, outcome from w"


_late = f"e.at_ms - w.since > {WINDOW_MS}"
_n = f"(case when {_late} then 0 else w.n end)"
_used = f"(case when w.tier > 1 and (w.success < 0 or e.at_ms - w.success > {AGAIN_MS}) then w.tier - 1 else w.tier end)"
_now = "(case when w.now = 'enriching' and w.lease < e.at_ms then 'queued' else w.now end)"
_next = f"""case when e.status = 'running' and {_now} in ('queued', 'partial') then 'enriching' when e.status = 'success' and {_now} = 'enriching' then 'ready' when e.status = 'completed' and {_now} = 'enriching' then 'partial'
    when e.status = 'failed' and {_now} = 'enriching' then case when w.attempts >= {ATTEMPTS} then 'failed' else 'queued' end when e.status = 'aborted' and {_now} in ('queued', 'partial') then 'expired' else {_now} end"""
_claims = f"(e.status = 'running' and {_now} in ('queued', 'partial'))"
_tokens = f"least({CAPACITY}::double, w.tokens + greatest(0, e.at_ms - w.last)::double / 60000 * {RATE_PER_MIN!r}::double)"
_base = "list_sort(w.good)[(len(w.good) + 1) // 2]"
_kind = f"(case when e.rows = 0 then 'zero_rows' when len(w.good) = 0 or {_base} < {LEAST_BASELINE} or e.rows >= floor({_base} * {DROP_RATIO}) then 'healthy' else 'drop' end)"
TWINS = {
    "st_circuit_breaker": walked(
        "n since until", "0::bigint | at_ms | 0::bigint",
        f"case when e.status = 'failed' then case when {_n} + 1 >= {FAILURES} then 0 else {_n} + 1 end when {OK} then greatest(0, w.n - 1) else w.n end"
        f" | case when e.status = 'failed' and ({_n} + 1 >= {FAILURES} or {_late}) then e.at_ms else w.since end | case when e.status = 'failed' and {_n} + 1 >= {FAILURES} then e.at_ms + {COOL_MS} else w.until end",
        f"case when e.status = 'failed' and {_n} + 1 >= {FAILURES} then 'opened' when e.at_ms < w.until then 'open' else 'closed' end"),
    "st_tier_learning": walked(
        "tier failures success", "1::bigint | 0::bigint | -1::bigint",
        f"case when e.status = 'failed' then case when w.failures + 1 >= {RAISE} then least({MOST_TIER}, {_used} + 1) else {_used} end when e.status = 'success' then {_used} when e.status = 'completed' then least({MOST_TIER}, {_used} + 1) else w.tier end"
        f" | w.failures + (e.status = 'failed')::bigint | case when {OK} then e.at_ms else w.success end",
        f"{_used}::varchar"),
    "st_status_machine": walked(
        "now attempts lease", "'queued' | 0::bigint | 0::bigint",
        f"{_next} | w.attempts + {_claims}::bigint | case when {_claims} then e.at_ms + {LEASE_MS} else w.lease end", _next),
    "st_drift_stream": walked(
        "good drops", "[]::bigint[] | 0::bigint",
        f"case when {OK} and e.rows > 0 then list_append(w.good, e.rows::bigint)[-{GOOD_RUNS}:] else w.good end | case when not {OK} then w.drops when {_kind} = 'drop' then w.drops + 1 else 0 end",
        f"case when not {OK} then 'unfinished' when {_kind} <> 'drop' then {_kind} when (w.drops + 1) % {STREAK} = 0 then 'escalated' else 'soft_drop' end"),
    "st_token_bucket": walked(
        "tokens last", f"{CAPACITY}::double | at_ms", f"case when {_tokens} >= 1 then {_tokens} - 1 else {_tokens} end | greatest(w.last, e.at_ms)", f"case when {_tokens} >= 1 then 'taken' else 'refused' end"),
}


def folded(stream: DataFrame, step) -> DataFrame:
    """run_id, robot_id, outcome: `step` applied to each robot's runs by time, with its state, as JSON, kept between batches."""

    def run(key, parts, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["at_ms", "run_id"])
        outcomes = []
        for status, at, found in zip(rows["status"], rows["at_ms"], rows["found"], strict=True):
            held, outcome = step(held, status, int(at), int(found))
            outcomes.append(outcome)
        state.update((json.dumps(held),))
        yield pd.DataFrame({"run_id": rows["run_id"], "robot_id": rows["robot_id"], "outcome": outcomes})

    rows = stream.where("robot_id is not null and at_ms is not null").select("run_id", "robot_id", "status", "at_ms", F.coalesce(F.floor("value"), F.lit(0)).cast("long").alias("found"))
    return rows.groupBy("robot_id").applyInPandasWithState(run, "run_id long, robot_id long, outcome string", "held string", "append", GroupStateTimeout.NoTimeout)


def _register(name: str) -> None:
    def run(spark, d):
        return drained(folded(arriving(spark, d), FOLDS[name]), fresh_path(spark, "stream-fold"))

    run.__name__, run.__doc__ = name, FOLDS[name].__doc__
    query(TWINS[name], "runs")(run)


for _name in FOLDS:
    _register(_name)


# Sweeps: one pass over the table


@query(f"select run_id, case when at_ms + 900000 < {NOW_MS} then 'queued' else status end as status from runs where status = 'running'", "runs")
def st_lease_recover(spark, d):
    """Claims whose lease has run out are queued again."""
    return runs(spark, d).where("status = 'running'").select("run_id", F.when(F.col("at_ms") + LEASE_MS < NOW_MS, "queued").otherwise(F.col("status")).alias("status"))


@query(f"select run_id, case when {NOW_MS} - at_ms < 120000 then 'alive' when coalesce(run_id % 5, 0) >= 3 then 'failed' else 'requeued' end as action from runs where status = 'running'", "runs")
def st_orphan_recovery(spark, d):
    """Running runs without a recent heartbeat start again, or fail once they have been tried three times."""
    silent = F.lit(NOW_MS) - F.col("at_ms") >= 120_000
    return runs(spark, d).where("status = 'running'").select("run_id", F.when(~silent, "alive").when(F.col("run_id") % 5 >= 3, "failed").otherwise("requeued").alias("action"))


@query(f"select robot_id, min_by(run_id, (at_ms, run_id)) as next_run, count(*) as waiting from runs where status = 'running' and robot_id not in (select robot_id from runs where status = 'aborted' and robot_id is not null) group by robot_id".replace("min_by(run_id, (at_ms, run_id))", "arg_min(run_id, (at_ms, run_id))"), "runs")
def st_schedule_fire(spark, d):
    """A robot with an active run is not started again; of the others the run that has waited longest is."""
    r = runs(spark, d)
    busy = r.where("status = 'aborted'").select("robot_id").distinct()
    return r.where("status = 'running'").join(busy, "robot_id", "left_anti").groupBy("robot_id").agg(F.min_by("run_id", F.struct("at_ms", "run_id")).alias("next_run"), F.count("*").alias("waiting"))


@query("select w.name as span, count(r.run_id) as n, count(r.run_id) filter (where r.status = 'failed') as failed from (values ('6h', 6), ('24h', 24), ('all', 1000000::bigint)) w(name, hours) left join (select *, (select max(at_ms) from runs) - at_ms as ago from runs) r on r.ago < w.hours * 3600000 group by w.name", "runs")
def st_digest(spark, d):
    """Runs and failures of the last 6 and 24 hours before the newest run, and of all time."""
    r = runs(spark, d)
    ago = F.lit(r.agg(F.max("at_ms")).first()[0] or 0) - F.col("at_ms")
    spans = (("6h", 6), ("24h", 24), ("all", 1_000_000))
    counts = r.agg(*[F.count_if(ago < h * HOUR).alias(f"n_{s}") for s, h in spans], *[F.count_if((ago < h * HOUR) & (F.col("status") == "failed")).alias(f"f_{s}") for s, h in spans])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("span"), F.col(f"n_{s}").alias("n"), F.col(f"f_{s}").alias("failed")) for s, _ in spans])))


@query("select robot_id, coalesce(bool_or(status = 'running' and run_id % 4 = 0), false) as exclusive_held, count(*) filter (where status = 'running') as holders, count(*) filter (where status = 'running') = 0 or (not coalesce(bool_or(status = 'running' and run_id % 4 = 0), false) and count(*) filter (where status = 'running') < 3) as may_share from runs group by robot_id", "runs")
def st_slot_lease(spark, d):
    """Whether one more may share a slot: nobody holds it, or fewer than three share it and none holds it alone."""
    on = F.col("status") == "running"
    x = runs(spark, d).groupBy("robot_id").agg(F.coalesce(F.bool_or(on & (F.col("run_id") % 4 == 0)), F.lit(False)).alias("exclusive_held"), F.count_if(on).alias("holders"))
    return x.withColumn("may_share", (F.col("holders") == 0) | (~F.col("exclusive_held") & (F.col("holders") < 3)))
