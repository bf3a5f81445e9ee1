"""Rules of stateful streams on hand-worked runs; streams that are started again. The streams against walks in SQL are in test_queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.sources.storage import fresh_path
from harvestry.streaming import enrichment, jobs


def test_state_is_kept_between_batches(spark, tmp_path):
    """Two files, one a batch: the second goes on from the first one's state."""
    where = tmp_path / "events.parquet"
    rows = [(i, i * 1000, 1, "error", 1.0) for i in range(1, 5)]
    frame = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string, value double").select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    path = fresh_path(spark, "test-kept")
    for part in ("event_id <= 2", "event_id > 2"):
        frame.where(part).coalesce(1).write.mode("append").parquet(str(where))
        out = jobs.drained(jobs.folded(jobs.arriving(spark, str(tmp_path)), jobs.breaker), path)
    assert {r.run_id: r.outcome for r in out.collect()} == {1: "closed", 2: "closed", 3: "opened", 4: "open"}


def outcomes(step, runs, **settings):
    state, said = [], []
    for at, status, *rows in runs:
        state, outcome = step(state, status, at, *(rows or [1]), **settings)
        said.append(outcome)
    return said, state


def test_a_breaker_counts_on_while_open_and_keeps_its_window():
    said, _ = outcomes(jobs.breaker, [(1, "failed"), (2, "success"), (3, "failed"), (4, "failed"), (5, "failed"), (6, "failed"), (7, "success"), (105, "running"), (110, "success")], failures=3, window=1000, cool=100)
    assert said == ["closed", "closed", "closed", "closed", "opened", "open", "open", "closed", "closed"]
    hour = 3_600_000  # a success that brings the count to nothing does not begin a new window
    said, _ = outcomes(jobs.breaker, [(0, "failed"), (1, "success"), (5 * hour, "failed"), (int(6.5 * hour), "failed"), (int(6.6 * hour), "failed")], failures=3, window=6 * hour, cool=12 * hour)
    assert said == ["closed"] * 5


def test_tiers_rise_by_all_failures_and_fall_after_a_rest():
    day = 86_400_000
    said, state = outcomes(jobs.tier, [(1, "failed"), (2, "success"), (3, "failed"), (4, "success"), (5, "failed"), (6, "success"), (7, "failed"), (40 * day, "running"), (41 * day, "success"), (42 * day, "completed")])
    assert said == ["1", "1", "1", "1", "1", "2", "2", "2", "2", "2"] and state[0] == 3
    assert outcomes(jobs.tier, [(1, "failed"), (2, "failed"), (3, "failed"), (4, "running")])[0][-1] == "1"  # never a success: tried lower again


def test_a_row_of_drops_escalates_once_in_three():
    runs = [(i, "success", n) for i, n in enumerate([100, 90, 110, 10, 9, 8, 7, 100, 0, 0])] + [(10, "failed", 0), (11, "completed", 100)]
    assert outcomes(jobs.drift, runs)[0] == ["healthy", "healthy", "healthy", "soft_drop", "soft_drop", "escalated", "healthy", "healthy", "zero_rows", "zero_rows", "unfinished", "healthy"]


def test_a_bucket_fills_with_time():
    said, _ = outcomes(jobs.bucket, [(0, "x"), (1, "x"), (2, "x"), (60_002, "x"), (60_003, "x"), (600_000, "x"), (600_000, "x"), (600_000, "x")], rate=1.0, capacity=2.0)
    assert said == ["taken", "taken", "refused", "taken", "refused", "taken", "taken", "refused"]


def test_a_listing_ends_after_its_attempts():
    runs = [(1000 * n + 1, status) for n in range(jobs.ATTEMPTS) for status in ("running", "failed")]
    assert outcomes(jobs.listing_state, runs)[0] == ["enriching", "queued"] * (jobs.ATTEMPTS - 1) + ["enriching", "failed"]
    assert jobs.listing_state(["enriching", 1, 5], "running", 6, 1)[1] == "enriching" and jobs.listing_state(["enriching", 1, 5], "success", 6, 1)[1] == "queued"


def test_the_enrichment_loop_goes_on_where_it_was(spark, tmp_path):
    """Three batches, the second killed halfway and run again: leases run out, budgets hold, nothing is claimed twice."""
    kind = "key long, at_ms long"
    minute, day = 60_000, 86_400_000
    parts = [[(k, 1000 + k) for k in range(6)], [(k, 20 * minute) for k in range(10)], [(0, day + 1)]]
    results = spark.createDataFrame([(k, None if k == 1 else "ready", 10) for k in range(10) if k != 2], "key long, outcome string, cost long")
    where, path = str(tmp_path / "in"), fresh_path(spark, "test-enrich")
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(where)
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(where)
        if n == 1:  # a pass whose table is half written is written again
            spark.createDataFrame([(99, "ready", 1, None, 0, 0, 0)], enrichment.QUEUE).write.parquet(f"{path}/queue-1")
        got = {r.key: r for r in enrichment.enrich(stream(), results, path, claimed=4, budget=30).collect()}
        again = {r.key: r for r in enrichment.enrich(stream(), results, path, claimed=4, budget=30).collect()}
        assert got == again
        if n == 0:
            assert [got[k].status for k in range(6)] == ["ready", "queued", "enriching", "ready", "queued", "queued"] and got[2].lease_until == 1005 + jobs.LEASE_MS
    assert sorted(got) == list(range(10)) and got[0].attempts == 1 and got[2].attempts == 3
    assert [got[k].status for k in (1, 2, 3, 4, 5)] == ["queued", "enriching", "ready", "ready", "ready"]
