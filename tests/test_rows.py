"""Row operators on cases of known result."""

from __future__ import annotations

import pytest

from harvestry import catalog
from harvestry.operators.rows import href_score


def test_href_scores(spark):
    cases = {"https://a.com/jobs": -107.875, "https://a.com/job/writer": 232.275, "https://a.com/jobs/12": 232.2, "https://a.com/team/jobs/": -107.725, "https://a.com": 12.025, "#x": -999.0, "javascript:go()": -999.0}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: r.s for r in df.select("u", href_score(df.u).alias("s")).collect()}
    assert got == pytest.approx(cases)


def test_start_row_is_reset_once(spark, sf):
    got = {r.url for r in catalog.QUERIES["hp_url_sf_start"](spark, sf).collect()}
    assert {"https://c.com/go/x?q=a&startrow=0&loc=b#f", "https://c.com/search/?q=a&startrow=0", "not a url"} <= got


def test_blocked_addresses(spark, sf):
    for r in catalog.QUERIES["flt_cidr"](spark, sf).collect():
        first, _, rest = r.ip.partition(".")
        if first == "172":
            assert r.unsafe == (16 <= int(rest.split(".")[0]) <= 31)
        elif first == "198":
            assert r.unsafe == (18 <= int(rest.split(".")[0]) <= 19)
        elif first == "100":
            assert r.unsafe == (64 <= int(rest.split(".")[0]) <= 127)
        else:
            assert r.unsafe == (first in ("10", "224") or (first == "192" and int(r.ip.rsplit(".", 1)[1]) < 256))


def test_fields_told_by_texts(spark, sf):
    rows = {r.doc_id % 6: (r.years, r.employment, r.place) for r in catalog.QUERIES["fn_derive_fields"](spark, sf).collect()}
    assert [rows[i] for i in range(3)] == [(5, "Part-time", "Remote"), (3, "Contract", "Onsite"), (0, "Internship", "Hybrid")]
    assert rows[3][1] == "Full-time"


def test_slug_titles(spark, sf):
    rows = {r.page_id % 4: r.title for r in catalog.QUERIES["hp_agg_title_slug"](spark, sf).collect()}
    assert (rows[0], rows[1], rows[3]) == ("Senior Data Engineer Austin Tx", "Qa Lead", None)
