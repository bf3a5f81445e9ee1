"""What keeps work in proportion to the input: rows spread over cores, values worked out once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from harvestry import catalog
from harvestry.functions.text import decode_entities


@pytest.mark.parametrize("name", ["src_aggregator_record", "fn_education", "fn_salary_aggregator", "fn_benefits"])
def test_rows_of_a_small_file_are_spread_over_cores(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_descriptions_are_scored_once(spark, sf):
    plan = catalog.QUERIES["fn_best_description"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count(r"who\s+you\s+are") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["udf_field_spec", "html_scrape_list"])
def test_texts_of_pages_are_joined_once(name, spark, sf):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS page_text") == 1


def test_decoding_reads_its_text_once(spark):
    assert decode_entities(F.col("page_html"))._jc.toString().count("page_html") == 1
    texts = spark.createDataFrame([("a &amp;lt; &#x41;&#66; &#1114112;",), ("plain  text",), (None,)], "t string")
    assert [r[0] for r in texts.select(decode_entities(F.col("t"))).collect()] == ["a < AB", "plain text", None]
