"""Rows whose values stand in the wrong columns, put right by rules in order; field specifications; aggregates of their own kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions.text import entities_sql
from harvestry.functions.urls import ONCE, REPEATED
from harvestry.plans.views import listings, runs, table
from harvestry.registry import query
from harvestry.sources.dom import scrape_ranked
from harvestry.sources.pages import ITEMS

#: Words that titles of postings have, towns and countries that stand in the company's column, tags of departments, labels that are no company.
JOBS = "engineer analyst manager developer specialist supervisor lead devops qa architect scientist consultant director officer administrator designer associate experience".split()
TOWNS = "mumbai bangalore bengaluru delhi pune chennai hyderabad kolkata gurgaon noida".split()
LANDS = ("inde", "india")
TAGS = ("ai&tech", "internalrole", "consulting", "design")
LABELS = ("people", "global administration")
LEAST_TITLE, LONGEST_TAG = 6, 80


def tokens(c: Column) -> Column:
    return F.split(F.lower(c), "[^a-z0-9_]+")


def titled(c: Column) -> Column:
    return (F.length(c) >= LEAST_TITLE) & F.arrays_overlap(tokens(c), F.array(*map(F.lit, JOBS)))


def placed(c: Column) -> Column:
    low = F.lower(c)
    towns = F.exists(F.array(*map(F.lit, TOWNS)), lambda t: low.contains(t))
    return towns | F.exists(tokens(c), lambda w: w.endswith(LANDS[0]) | w.endswith(LANDS[1]))


def tagged(c: Column) -> Column:
    """A department's tag; its words stand apart as they are written there."""
    low = F.regexp_replace(F.lower(c), r"\s+", " ")
    return (F.length(c) <= LONGEST_TAG) & (F.replace(low, F.lit(" "), F.lit("")).isin(*TAGS)) & (low.contains("&") | low.isin("internal role", "consulting", "design"))


def realigned(rows: DataFrame) -> DataFrame:
    """rows: title, company, location, category, description, url, trimmed and not null -> the same, each rule on what the one before left.

    A title in the place's column; a place in the company's; a title in the category's, behind a department's tag; a department as a company;
    a company that its site tells; a repeated part of a URL; a menu's label as the company.
    """
    rows = rows.withColumn("raw_category", F.col("category")).withColumn("raw_title", F.col("title"))
    t, c, p, k = (F.col(x) for x in ("title", "company", "location", "category"))
    moved = (p != "") & titled(p) & (~titled(t) | (F.length(t) < F.length(p)))
    rows = rows.withColumns({"title": F.when(moved, p).otherwise(t), "location": F.when(moved, "").otherwise(p)})
    there = (c != "") & placed(c) & ((p == "") | (p == c))
    rows = rows.withColumns({"location": F.when(there, c).otherwise(p), "company": F.when(there, "").otherwise(c)})
    behind = (k != "") & (t != "") & (F.length(k) > F.length(t)) & titled(k) & (tagged(t) | ~titled(t))
    same = (F.col("description") != "") & ((F.col("description") == F.col("raw_category")) | (F.col("description") == F.col("raw_title")))
    rows = rows.withColumns({"title": F.when(behind, k).otherwise(t), "category": F.when(behind, t).otherwise(k), "description": F.when(behind & same, k).otherwise(F.col("description"))})
    inner = F.lower(c).isin(*LABELS) & (k == "")
    rows = rows.withColumns({"category": F.when(inner, c).otherwise(k), "company": F.when(inner, "").otherwise(c)})
    url = F.col("url")
    rows = rows.withColumn("company", F.when(F.lower(url).contains("sia-partners.com") & F.lower(url).contains("/career/") & (c == ""), "SIA Partners").otherwise(c))
    rows = rows.withColumn("url", F.regexp_replace(url, REPEATED, ONCE.format("$")))
    return rows.withColumn("company", F.when(F.lower(url).contains("google.com/about/careers") & F.lower(c).isin("career", "careers"), "Google").otherwise(c)).drop("raw_category", "raw_title")


_shift = """m as (select page_id, trim(case page_id % 8 when 1 then 'Internal  Role' when 2 then 'AI & Tech' else title end) as title, trim(coalesce(case page_id % 6 when 0 then 'Pune, Inde' when 1 then 'People' when 2 then '' when 3 then 'Careers' else s_company end, '')) as company,
  trim(coalesce(case page_id % 5 when 0 then 'Senior Data Engineer ' || page_id when 1 then '' when 2 then 'Pune, Inde' else s_location end, '')) as location, trim(coalesce(case when page_id % 8 in (1, 2) then 'Lead QA of ' || s_category when page_id % 6 = 1 then '' else s_category end, '')) as category,
  case page_id % 4 when 0 then 'words' when 1 then trim('Lead QA of ' || coalesce(s_category, '')) else trim(title) end as description, case page_id % 7 when 0 then 'https://www.sia-partners.com/en/career/' || page_id when 1 then 'https://www.google.com/about/careers/applications/jobs/jobs/results/' || page_id else url end as url from listings)"""
_l = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_tok = lambda c: f"string_split_regex(lower({c}), '[^a-z0-9_]+')"
_ti = lambda c: f"(length({c}) >= {LEAST_TITLE} and list_has_any({_tok(c)}, {_l(JOBS)}))"
_pl = lambda c: f"(len(list_filter({_l(TOWNS)}, lambda x: contains(lower({c}), x))) > 0 or len(list_filter({_tok(c)}, lambda x: ends_with(x, 'inde') or ends_with(x, 'india'))) > 0)"
_one = f"location <> '' and {_ti('location')} and (not {_ti('title')} or length(title) < length(location))"
_two = f"company <> '' and {_pl('company')} and (location = '' or location = company)"
_three = f"category <> '' and title <> '' and length(category) > length(title) and {_ti('category')} and (regexp_full_match(lower(title), 'ai\\s*&\\s*tech|internal\\s+role|consulting|design') or not {_ti('title')})"


@query(f"""with {_shift},
a as (select * replace (case when {_one} then location else title end as title, case when {_one} then '' else location end as location), title as raw_title from m),
b as (select * replace (case when {_two} then company else location end as location, case when {_two} then '' else company end as company) from a),
c as (select * replace (case when {_three} then category else title end as title, case when {_three} then title else category end as category, case when {_three} and description <> '' and description in (category, raw_title) then category else description end as description) from b),
d as (select * replace (case when lower(company) in ('people', 'global administration') and category = '' then company else category end as category, case when lower(company) in ('people', 'global administration') and category = '' then '' else company end as company) from c),
e as (select * replace (case when url like '%sia-partners.com%/career/%' and company = '' then 'SIA Partners' else company end as company, replace(url, '/jobs/jobs/results', '/jobs/results') as url) from d)
select page_id, title, case when contains(url, 'google.com/about/careers') and lower(company) in ('career', 'careers') then 'Google' else company end as company, location, category, md5(description) as description, url from e""", "listings")
def prj_misaligned(spark, d):
    k = F.col("page_id")
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    lead = F.concat(F.lit("Lead QA of "), "s_category")
    rows = listings(spark, d).select(
        "page_id", F.trim(F.when(k % 8 == 1, "Internal  Role").when(k % 8 == 2, "AI & Tech").otherwise(F.col("title"))).alias("title"), blank(F.when(k % 6 == 0, "Pune, Inde").when(k % 6 == 1, "People").when(k % 6 == 2, "").when(k % 6 == 3, "Careers").otherwise(F.col("s_company"))).alias("company"),
        blank(F.when(k % 5 == 0, F.concat(F.lit("Senior Data Engineer "), k.cast("string"))).when(k % 5 == 1, "").when(k % 5 == 2, "Pune, Inde").otherwise(F.col("s_location"))).alias("location"), blank(F.when((k % 8).isin(1, 2), lead).when(k % 6 == 1, "").otherwise(F.col("s_category"))).alias("category"),
        F.when(k % 4 == 0, "words").when(k % 4 == 1, F.trim(F.concat(F.lit("Lead QA of "), F.coalesce("s_category", F.lit(""))))).otherwise(F.trim("title")).alias("description"),
        F.when(k % 7 == 0, F.concat(F.lit("https://www.sia-partners.com/en/career/"), k.cast("string"))).when(k % 7 == 1, F.concat(F.lit("https://www.google.com/about/careers/applications/jobs/jobs/results/"), k.cast("string"))).otherwise(F.col("url")).alias("url"),
    )
    return realigned(rows).select("page_id", "title", "company", "location", "category", F.md5("description").alias("description"), "url")


SPECS = {"text": ["li > a", "value@none"], "address": ["a@href"], "missing": ["a@title", "b", "value@unknown"], "whole": ["li"]}


@query(f"with {ITEMS} select page_id, position::int as position, {entities_sql('name')} as text, {entities_sql('link')} as address, 'unknown' as missing, {entities_sql('name')} as whole from i where position < 4")
def udf_field_spec(spark, d):
    """Fields by specifications: a selector, `selector@attribute` or `value@text`, the first that gives something; four items of each menu."""
    return scrape_ranked(table(spark, d, "pages"), "nav ul > li", SPECS, limit=4).select("page_id", "position", *SPECS)


@query("""with r as (select robot_id, rows_extracted as v, at_ms, run_id, row_number() over (partition by robot_id order by rows_extracted) as nth, count(rows_extracted) over (partition by robot_id) as n, lag(at_ms) over (partition by robot_id order by at_ms, run_id) as since from runs where robot_id is not null and rows_extracted is not null)
select robot_id, max(v) filter (nth = least(n, floor(n * 0.95) + 1)) as p95, max(v) filter (nth = (n + 1) // 2) as lower_median, round(coalesce(sum(v * (at_ms - since)) / nullif(sum(at_ms - since), 0), arg_max(v, (at_ms, run_id))), 6) as weighted from r group by robot_id""", "runs")
def udaf_custom(spark, d):
    """Of each robot's rows: the value at the index of nineteen twentieths, the lower of the middle two, and the mean weighted by the time since the run before each, the last value where no time passed."""
    own = runs(spark, d).where("robot_id is not null and rows_extracted is not null")
    by_value, by_time = Window.partitionBy("robot_id").orderBy("rows_extracted"), Window.partitionBy("robot_id").orderBy("at_ms", "run_id")
    n = F.count("*").over(Window.partitionBy("robot_id"))
    held = F.col("at_ms") - F.lag("at_ms").over(by_time)
    x = own.select("robot_id", "at_ms", "run_id", F.col("rows_extracted").alias("v"), F.row_number().over(by_value).alias("nth"), n.alias("n"), held.alias("held"))
    at = lambda place: F.max(F.when(F.col("nth") == place, F.col("v")))
    mean = F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("held")), F.sum("held")), F.max_by("v", F.struct("at_ms", "run_id")))
    return x.groupBy("robot_id").agg(at(F.least(F.col("n"), F.floor(F.col("n") * 0.95) + 1)).alias("p95"), at(F.floor((F.col("n") + 1) / 2)).alias("lower_median"), F.round(mean, 6).alias("weighted"))
