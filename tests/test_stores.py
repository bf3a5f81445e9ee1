"""Stored tables that are merged into, and chains of retries of any length."""

from __future__ import annotations

from harvestry.operators.listings import merged_into, upserts
from harvestry.operators.runs import lineage
from harvestry.sources.storage import fresh_path


def test_merging_touches_only_the_rows_keys(spark):
    path = fresh_path(spark, "test-merge")
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("id", "v").collect())
    merged_into(path, frame([(i, "a") for i in range(20)]), "id")
    for _ in range(2):
        merged_into(path, frame([(3, "b"), (40, "b")]), "id")
        assert read() == sorted([(i, "b" if i == 3 else "a") for i in range(20)] + [(40, "b")])
    merged_into(path, frame([]), "id")
    assert len(read()) == 21


def test_upserts(spark):
    stored = spark.createDataFrame([("k1", 1, "old", "ready")], "key string, page_id long, title string, status string")
    long = "x" * 400
    batch = [("k1", 5, "t", 9, "c", "d", "l"), ("k1", 4, "lost", 9, "c", "d", "l"), ("k2", 6, "t", 9, "c", long, "l"), ("k3", 7, "t", 9, "", long, "l"), (None, 8, "t", 9, "c", long, "l"), ("k4", 9, "t", 1, "c", long, "l")]
    got = upserts(stored, spark.createDataFrame(batch, "key string, page_id long, title string, created_ms long, s_company string, description string, location string"), 5)
    assert sorted(tuple(r) for r in got.collect()) == [("k1", 5, "t", "ready"), ("k2", 6, "t", "ready"), ("k3", 7, "t", "queued")]


def test_long_chains_loops_and_lost_runs(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    odd = [(1000, 1001), (1001, 1000), (2000, 1999), (2001, 2000), (3000, 3000)]
    got = {r.run_id: (r.root, r.depth) for r in lineage(spark.createDataFrame(chain + odd, "run_id long, retry_of long")).collect()}
    assert got == {i: (0, i) for i in range(300)}
