"""The enrichment loop as a stream: each batch of arrivals is queued, leases that ran out are taken back, the longest waiting listings are claimed within the day's budget, and their results are stored.

The queue is a table that each pass writes as a new version, named by the batch; a pass that is repeated after a
crash starts from the version before it and writes the same one again, so that nothing is claimed or paid twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.operators.listings import stored_at
from harvestry.plans.views import runs
from harvestry.registry import query
from harvestry.sources.storage import fresh_path
from harvestry.streaming.jobs import DAY, LEASE_MS, arriving

#: Listings that a pass claims, credits of a day, and attempts before a listing has failed.
CLAIMED, BUDGET, ATTEMPTS = 40, 400, 4
QUEUE = "key long, status string, attempts int, lease_until long, due long, spent long, day long"


def recovered(queue: DataFrame, now: int) -> DataFrame:
    """Claims whose lease has run out are queued again."""
    over = (F.col("status") == "enriching") & (F.col("lease_until") < now)
    return queue.withColumn("status", F.when(over, "queued").otherwise(F.col("status"))).withColumn("lease_until", F.when(over, None).otherwise(F.col("lease_until")))


def arrived(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """New keys are queued, due when they first came; known ones stay as they are."""
    new = rows.groupBy("key").agg(F.min("at_ms").alias("due")).join(queue.select("key"), "key", "left_anti")
    empty = {"status": F.lit("queued"), "attempts": F.lit(0), "lease_until": F.lit(None).cast("long"), "spent": F.lit(0).cast("long"), "day": F.lit(None).cast("long")}
    return queue.unionByName(new.select("key", "due", *[c.alias(n) for n, c in empty.items()]))


def passed(queue: DataFrame, results: DataFrame, now: int, claimed: int = CLAIMED, budget: int = BUDGET) -> DataFrame:
    """One pass: of what is queued and due the longest waiting are claimed, at most `claimed` and for what the day's budget has left, and take their results (key, outcome, cost): ready or partial, or, if that is null, queued again for later, from the last attempt on failed. A claim without a result keeps its lease."""
    left = queue.agg(F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum(F.when(F.col("day") == now // DAY, F.col("spent"))), F.lit(0))).alias("left"))
    due = queue.where((F.col("status") == "queued") & (F.col("due") <= now)).join(results, "key", "left")
    first = due.orderBy("due", "key").limit(claimed)  # the limit is what a pass may claim
    cost = F.sum(F.coalesce("cost", F.lit(0))).over(Window.orderBy("due", "key"))  # `claimed` rows
    mine = first.withColumn("so_far", cost).where(F.col("so_far") <= left.scalar())
    again = F.col("attempts") + 1
    answered = F.col("cost").isNotNull()
    status = F.when(~answered, "enriching").when(F.col("outcome").isNotNull(), F.col("outcome")).when(again >= ATTEMPTS, "failed").otherwise("queued")
    done = mine.select(
        "key", status.alias("status"), again.alias("attempts"), F.when(~answered, F.lit(now + LEASE_MS)).alias("lease_until"), F.when(answered & F.col("outcome").isNull(), F.lit(now + 60_000)).otherwise(F.col("due")).alias("due"),
        (F.when(F.col("day") == now // DAY, F.col("spent")).otherwise(0) + F.coalesce("cost", F.lit(0))).alias("spent"), F.lit(now // DAY).cast("long").alias("day"),
    )
    return queue.join(done.select("key"), "key", "left_anti").unionByName(done)


def enrich(stream: DataFrame, results: DataFrame, path: str, claimed: int = CLAIMED, budget: int = BUDGET) -> DataFrame:
    """Run the loop over a stream (key, at_ms) until it is drained; the queue as it is then. results: what asking for a key gives."""
    spark: SparkSession = stream.sparkSession

    def step(rows: DataFrame, batch: int) -> None:
        before, now_path = f"{path}/queue-{batch - 1}", f"{path}/queue-{batch}"
        queue = spark.read.schema(QUEUE).parquet(before) if batch and stored_at(spark, before) else spark.createDataFrame([], QUEUE)
        now = rows.agg(F.max("at_ms")).first()[0]
        if now is not None:
            queue = passed(arrived(recovered(queue, now), rows), results, now, claimed, budget)
        queue.select("key", "status", "attempts", "lease_until", "due", "spent", "day").write.mode("overwrite").parquet(now_path)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    ran = writer.start()
    ran.awaitTermination()
    last = max((int(f.getPath().getName().split("-")[1]) for f in files(spark, path) if f.getPath().getName().startswith("queue-")), default=None)
    return spark.createDataFrame([], QUEUE) if last is None else spark.read.schema(QUEUE).parquet(f"{path}/queue-{last}")


def files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)


@query(f"""with a as (select robot_id as key, min(at_ms) as due, max(at_ms) as seen, count(*) filter (where status = 'success') as good, count(*) as n from runs group by robot_id),
c as (select *, sum(case when key % 7 = 0 then 0 else n % 25 end) over (order by due, key) as so_far from (select * from a order by due, key limit {CLAIMED})),
m as (select * from c where so_far <= {BUDGET}), t as (select max(seen) as now from a)
select a.key, case when m.key is null then 'queued' when a.key % 7 = 0 then 'enriching' when a.good > 10 then 'ready' when a.good > 5 then 'partial' else 'queued' end as status, (m.key is not null)::int as attempts, coalesce(case when a.key % 7 <> 0 then a.n % 25 end * (m.key is not null)::int, 0) as spent
from a left join m on m.key = a.key""", "runs")
def st_enrich_loop(spark, d):
    """Robots as listings that come in with their runs; asking for one costs by its runs and gives ready or partial by its successes, and every seventh never answers."""
    rows = arriving(spark, d).select(F.col("robot_id").alias("key"), "at_ms")
    results = runs(spark, d).groupBy(F.col("robot_id").alias("key")).agg(F.count_if(F.col("status") == "success").alias("good"), (F.count("*") % 25).alias("cost")).where("key % 7 <> 0")
    results = results.select("key", F.when(F.col("good") > 10, "ready").when(F.col("good") > 5, "partial").alias("outcome"), "cost")
    return enrich(rows, results, fresh_path(spark, "stream-enrich")).select("key", "status", "attempts", "spent")
