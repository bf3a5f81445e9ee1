"""One Spark session for all tests, the small tables, and the comparison of a query with its SQL twin."""

from __future__ import annotations

import math
import os
import tempfile
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    home = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.local.dir": home,
        "spark.checkpoint.dir": f"file://{home}/shared", "spark.sql.warehouse.dir": f"{home}/warehouse", "spark.sql.maxMetadataStringLength": "200",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    return con


def cell(v) -> str:
    """One text for values that are equal in both engines: numbers by value, to nine digits."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(map(cell, v)) + "]"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | Decimal | np.number):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture
def same_as_sql(spark, duck, sf):
    def check(run, sql: str) -> int:
        got = run(spark, sf)
        want = duck.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        mine = rows_of(got.columns, ([x.asDict(True) if hasattr(x, "asDict") else x for x in r] for r in got.collect()))
        assert mine == rows_of(names, want.fetchall())
        return len(mine)

    return check
