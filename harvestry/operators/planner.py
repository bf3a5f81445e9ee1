"""Schedule planning: first runs packed 90 seconds apart, and daily runs spread over the hours of a day.

Both are greedy walks by their rule. Bounds on how late the walk can be, running maxima taken per bin and then over bins, tell
where it must be on time again and where one just follows the other; between the former, the rest is walked by itself. Daily runs fall
into rounds of at most 24: a level of the hours is filled before the next one, whatever hours the robots prefer.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.operators.helpers import DAY, IST_MS
from harvestry.plans.views import runs
from harvestry.registry import query
from harvestry.streaming.jobs import NOW_MS

HOUR, GAP = 3_600_000, 90_000
#: Wishes of one bin are sorted together.
BIN = 600_000


def packed(wanted: DataFrame, gap: int = GAP) -> DataFrame:
    """wanted: id, preferred (ms) -> with placed: each, in the order of preference and id, goes to its preferred time if that is `gap` from all placed before, else a gap after the later of that time and the last placed. Null preferences give no rows."""
    order = Window.partitionBy("bin").orderBy("preferred", "id")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    by_bin = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin that has any
    rows = wanted.where("preferred is not null").select("id", F.col("preferred").cast("long").alias("preferred"))
    rows = rows.withColumn("bin", F.floor(F.col("preferred") / BIN)).withColumn("k", F.row_number().over(order).cast("long"))
    # A walk of fixed steps is a running maximum: q_k = max(preferred_j - step j, j <= k) + step k, counted within a bin and carried from bin to bin.
    # Steps of two gaps are never ahead of the true walk, steps of one gap never behind it.
    steps = {"slow": 2 * gap, "fast": gap}
    bins = rows.groupBy("bin").agg(F.count("*").alias("n"), *[F.max(F.col("preferred") - step * F.col("k")).alias(name) for name, step in steps.items()])
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(by_bin), F.lit(0)))
    bins = bins.select("bin", "before", *[F.max(F.col(name) - step * F.col("before")).over(by_bin).alias(name) for name, step in steps.items()])
    rows = rows.join(bins, "bin").withColumn("i", F.col("before") + F.col("k"))
    latest, soonest = (F.greatest(name, F.max(F.col("preferred") - step * F.col("i")).over(prior)) + step * (F.col("i") - 1) for name, step in steps.items())
    # Where the one before is surely a gap away, an island begins; where it is surely at or after the wish, the place is a gap after it, whatever that is.
    rows = rows.withColumn("first", F.coalesce(F.col("preferred") >= latest + gap, F.lit(True))).withColumn("follows", F.coalesce(soonest >= F.col("preferred"), F.lit(False)))
    rows = rows.select("bin", "i", "id", "preferred", "first", "follows")
    open_ = rows.where("not follows")
    begins = open_.where("first").groupBy("bin").agg(F.max("i").alias("last_first"))
    carried = bins.join(begins, "bin", "left").select("bin", F.last("last_first", True).over(by_bin).alias("from_before"))
    open_ = open_.join(carried, "bin").withColumn("island", F.coalesce(F.max(F.when(F.col("first"), F.col("i"))).over(order), "from_before"))

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        base, place = [], None  # base: the place less a gap for each one before, the same for all that follow
        for i, wish in zip(table["i"].to_pylist(), table["preferred"].to_pylist(), strict=True):
            last = None if place is None else place + gap * (i - 1 - at)
            place, at = wish if last is None or wish - last >= gap else max(wish, last) + gap, i
            base.append(place - gap * i)
        return table.select(["bin", "i"]).append_column("base", pa.array(base, pa.int64()))

    walked = open_.select("island", "bin", "i", "preferred").groupBy("island").applyInArrow(walk, "bin long, i long, base long")
    last = walked.groupBy("bin").agg(F.max_by("base", "i").alias("last_base"))
    carried = bins.join(last, "bin", "left").select("bin", F.last("last_base", True).over(by_bin).alias("from_before"))
    rows = rows.join(walked, ["bin", "i"], "left").join(carried, "bin")
    return rows.select("id", "preferred", (F.coalesce(F.last("base", True).over(order), "from_before") + gap * F.col("i")).alias("placed"))


def wishes(spark, d) -> DataFrame:
    """Each robot's next run by its last one: a day later, within six hours of the day."""
    last = runs(spark, d).where("robot_id is not null").groupBy(F.col("robot_id").alias("id")).agg(F.max("at_ms").alias("at_ms"))
    return last.select("id", (F.lit(NOW_MS // DAY * DAY + DAY) + F.col("at_ms") % (6 * HOUR)).alias("preferred"))


@query(f"""with recursive wish as (select robot_id as id, {NOW_MS // DAY * DAY + DAY} + max(at_ms) % {6 * HOUR} as preferred from runs where robot_id is not null group by robot_id),
o as (select *, row_number() over (order by preferred, id) as i from wish),
w as (select 1 as step, 1 as i, (select preferred from o where i = 1) as candidate, []::bigint[] as taken, null::bigint as placed
  union all select w.step + 1, case when free then w.i + 1 else w.i end, case when free then o.preferred else greatest(w.candidate + {GAP}, until) end, case when free then list_append(w.taken, w.candidate) else w.taken end, case when free then w.candidate end
  from (select *, len(list_filter(taken, lambda t: abs(t - candidate) < {GAP})) = 0 as free, list_max(list_filter(taken, lambda t: abs(t - candidate) < {GAP})) + {GAP} as until from w) w
  left join o on o.i = w.i + 1 where w.candidate is not null)
select o.id as robot_id, o.preferred, w.placed from w join o on o.i = w.i - 1 where w.placed is not null""", "runs")
def win_pack_slots(spark, d):
    return packed(wishes(spark, d)).select(F.col("id").alias("robot_id"), "preferred", "placed")


def daily_plan(daily: DataFrame, fixed: DataFrame, now_ms: int = NOW_MS) -> DataFrame:
    """daily: id, current_hour (null: none); fixed: hour, offset (seconds) -> id, current_hour, hour, offset, next_ms.

    Robots by hour, those without one last, then by id, each take their own hour if it is one of the emptiest, else the first of
    those. While a level of the hours is filled every robot finds one of the hours at it, so robots of one level make a round of at most
    24, decided by itself; levels end up at most one apart, or at an hour's fixed runs, and nothing is left to be moved between hours.
    Within an hour the robots take the first free seconds 90 apart: multiples of 90 first, then between what is taken; beyond that
    the hour's last slot. The hour's fixed runs stay.
    """
    hours = daily.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    held = fixed.select(F.pmod(F.col("hour"), F.lit(24)).cast("int").alias("hour"), F.col("offset").cast("int").alias("offset"))
    reserved = hours.join(held.groupBy("hour").agg(F.count("*").alias("n")), "hour", "left").na.fill(0, ["n"])
    # A row for each level up to the fixed runs of the fullest hour, with the robots that come before it.
    top = reserved.agg(F.max("n").alias("top"), F.collect_list(F.struct("hour", "n")).alias("all"))
    level = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("level"), "all").select("level", F.array_sort(F.transform(F.filter("all", lambda x: x["n"] <= F.col("level")), lambda x: x["hour"])).alias("open"))
    level = level.withColumn("before", F.sum(F.size("open")).over(Window.orderBy("level")) - F.size("open")).withColumn("last", F.lead("level").over(Window.orderBy("level")).isNull())
    # Each robot's place in the order: within its hour, after the robots of the hours before.
    key = F.coalesce(F.col("current_hour"), F.lit(99))
    per_hour = daily.groupBy(key.alias("h")).agg(F.count("*").alias("n"))
    per_hour = per_hour.select("h", (F.sum("n").over(Window.orderBy("h")) - F.col("n")).alias("ahead"))  # 25 rows
    robots = daily.withColumn("h", key).withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("id"))).join(F.broadcast(per_hour), "h").withColumn("place", F.col("ahead") + F.col("k") - 1)
    size = F.size("open")
    in_level = (F.col("place") >= F.col("before")) & (F.col("last") | (F.col("place") < F.col("before") + size))
    robots = robots.join(F.broadcast(level), in_level).withColumn("round", F.when(F.col("last"), F.col("level") + F.floor((F.col("place") - F.col("before")) / size)).otherwise(F.col("level")))
    rounds = robots.groupBy("round", "open").agg(F.array_sort(F.collect_list(F.struct("place", "id", "current_hour"))).alias("robots"))

    def take(s, r):
        hour = F.when(F.array_contains(s["open"], F.coalesce(r["current_hour"], F.lit(-1))), r["current_hour"]).otherwise(F.array_min(s["open"])).cast("int")
        return F.struct(F.array_remove(s["open"], hour).alias("open"), F.array_append(s["done"], F.struct(r["id"].alias("id"), r["current_hour"].alias("current_hour"), r["place"].alias("place"), hour.alias("hour"))).alias("done"))

    id_kind, hour_kind = daily.schema["id"].dataType.simpleString(), daily.schema["current_hour"].dataType.simpleString()
    start = F.struct(F.col("open"), F.array().cast(f"array<struct<id: {id_kind}, current_hour: {hour_kind}, place: bigint, hour: int>>").alias("done"))
    chosen = rounds.select(F.inline(F.aggregate("robots", start, take)["done"]))
    # Seconds of an hour that are free, in the order in which they are given away.
    taken = hours.join(held.groupBy("hour").agg(F.array_sort(F.collect_set("offset")).alias("fixed")), "hour", "left").select("hour", F.coalesce("fixed", F.array().cast("array<int>")).alias("fixed"))
    coarse = F.filter(F.sequence(F.lit(0), F.lit(3599), F.lit(90)), lambda t: ~F.exists("fixed", lambda o: F.abs(o - t) < 90))
    taken = taken.withColumn("coarse", coarse)
    walls = F.array_sort(F.concat(F.array(F.lit(-90)), "fixed", "coarse", F.array(F.lit(3689))))
    between = F.flatten(F.transform(walls, lambda a, i: F.when(F.get(walls, i + 1) - a >= 180, F.sequence(a + 90, F.get(walls, i + 1) - 90, F.lit(90))).otherwise(F.array().cast("array<int>"))))
    slots = taken.select(F.col("hour").alias("slot_hour"), F.concat("coarse", between).alias("slots"))
    nth = F.row_number().over(Window.partitionBy("hour").orderBy("place"))
    placed = chosen.withColumn("nth", nth).join(F.broadcast(slots), F.col("hour") == F.col("slot_hour")).withColumn("offset", F.coalesce(F.get("slots", F.col("nth") - 1), F.lit(3510)))
    day = (now_ms + IST_MS) // DAY * DAY - IST_MS
    at = F.lit(day) + F.col("hour").cast("long") * HOUR + F.col("offset").cast("long") * 1000
    return placed.select("id", "current_hour", "hour", "offset", F.when(at > now_ms, at).otherwise(at + DAY).alias("next_ms"))


def fleet(spark, d) -> tuple[DataFrame, DataFrame]:
    """Robots that run daily, at the hour of their last run if it is known, and the slots of the others, by Indian time."""
    last = runs(spark, d).where("robot_id is not null").groupBy(F.col("robot_id").alias("id")).agg(F.max("at_ms").alias("at_ms"))
    local = F.col("at_ms") + IST_MS
    hour = F.floor(local / HOUR) % 24
    daily = last.where("id % 4 <> 0").select("id", F.when(F.col("id") % 11 != 0, F.floor(hour / 3)).cast("int").alias("current_hour"))
    return daily, last.where("id % 4 = 0").select((hour % 5).cast("int").alias("hour"), F.floor(local % HOUR / 1000).cast("int").alias("offset"))


_gap = "len(list_filter(taken, lambda o: abs(o - t) < 90)) = 0"


@query(f"""with recursive last as (select robot_id as id, max(at_ms) as at_ms from runs where robot_id is not null group by robot_id),
daily as (select id, case when id % 11 <> 0 then (at_ms + {IST_MS}) // {HOUR} % 24 // 3 end as current_hour from last where id % 4 <> 0),
fixed as (select (at_ms + {IST_MS}) // {HOUR} % 24 % 5 as hour, (at_ms + {IST_MS}) % {HOUR} // 1000 as o from last where id % 4 = 0),
o as (select *, row_number() over (order by coalesce(current_hour, 99), id) as i from daily),
w as (select 0::bigint as i, list(n order by h) as counts, null::bigint as hour from (select h.range as h, (select count(*) from fixed where hour = h.range) as n from range(24) h)
  union all select i, list_transform(counts, lambda c, k: c + (k - 1 = hour)::bigint), hour from (
    select o.i, w.counts, case when o.current_hour is not null and w.counts[o.current_hour + 1] = list_min(w.counts) then o.current_hour else list_position(w.counts, list_min(w.counts)) - 1 end as hour from w join o on o.i = w.i + 1)),
chosen as (select o.id, o.current_hour, w.hour, row_number() over (partition by w.hour order by w.i) as k from w join o using (i)),
s as (select h.range as hour, 0::bigint as k, (select coalesce(list(o), []) from fixed where hour = h.range) as taken, null::bigint as t from range(24) h
  union all select hour, k + 1, list_append(taken, t), t from (
    select s.hour, s.k, s.taken, coalesce(list_filter(range(0, 3600, 90), lambda t: {_gap})[1], list_filter(range(0, 3600), lambda t: {_gap})[1], 3510) as t from s where s.k < (select max(k) from chosen c where c.hour = s.hour)))
select id as robot_id, current_hour, chosen.hour, t as "offset", today + case when today > {NOW_MS} then 0 else {DAY} end as next_ms
from (select *, {(NOW_MS + IST_MS) // DAY * DAY - IST_MS} + chosen.hour * {HOUR} + t * 1000 as today from chosen join s using (hour, k)) chosen""", "runs")
def win_daily_plan(spark, d):
    """A day's plan for all robots that run daily: their hours, and their seconds within the hour."""
    return daily_plan(*fleet(spark, d)).withColumnRenamed("id", "robot_id")
