"""Rows whose values stand in the wrong columns, by hand-worked cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.operators.columns import realigned, tagged

KEYS = ("title", "company", "location", "category", "description", "url")
CASES = [
    (("Design", "Acme", "Senior QA Engineer", "x", "", "u"), ("Senior QA Engineer", "Acme", "", "x", "", "u")),
    (("Data Engineer", "Mumbai, Inde", "", "", "", "u"), ("Data Engineer", "", "Mumbai, Inde", "", "", "u")),
    (("AI & Tech", "Acme", "Rome", "Lead Data Scientist", "AI & Tech", "u"), ("Lead Data Scientist", "Acme", "Rome", "AI & Tech", "Lead Data Scientist", "u")),
    (("Baker", "PEOPLE", "Rome", "", "d", "https://www.sia-partners.com/en/career/1"), ("Baker", "SIA Partners", "Rome", "PEOPLE", "d", "https://www.sia-partners.com/en/career/1")),
    (("Baker", "Careers", "Rome", "c", "d", "https://www.google.com/about/careers/applications/jobs/jobs/results/7"), ("Baker", "Google", "Rome", "c", "d", "https://www.google.com/about/careers/applications/jobs/results/7")),
    (("Manager", "Acme", "Rome", "", "", ""), ("Manager", "Acme", "Rome", "", "", "")),
]


def test_rules_in_order(spark):
    got = realigned(spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(CASES)], "i int, " + ", ".join(f"{k} string" for k in KEYS))).orderBy("i").select(*KEYS).collect()
    assert [tuple(r) for r in got] == [want for _, want in CASES]


def test_tags_of_departments(spark):
    asked = ["AI&Tech", "ai  & tech", "Internal  role", "Internalrole", "Design", "Designer", "aitech"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i int, x string").select("i", tagged(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [True, True, True, False, True, False, False]
