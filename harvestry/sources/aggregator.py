"""The aggregator's nested records as postings: a table of paths says where a field may stand, the first that is not blank wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.text import decode_entities, let, strip_html
from harvestry.plans.views import spread, table
from harvestry.registry import query

#: Where each field may stand, in order of precedence.
JOB, DATA, FIRM, FIRM_DATA = "$.job_information", "$.v5_processed_job_data", "$.enriched_company_data", "$.v5_processed_company_data"
PATHS = {
    "title": (f"{JOB}.title", f"{JOB}.job_title_raw", f"{DATA}.core_job_title", "$.title", "$.jobTitle"),
    "company": (f"{FIRM}.name", f"{DATA}.company_name", f"{FIRM_DATA}.name", "$.companyName", "$.company"),
    "description": (f"{JOB}.description", "$.description", "$.jobDescription"),
    "date": (f"{DATA}.estimated_publish_date", "$.date", f"{JOB}.date"),
    "category": (f"{DATA}.job_category", "$.jobCategory", "$.category"),
    "website": (f"{FIRM}.homepage_uri", f"{DATA}.company_website", f"{FIRM}.website"),
    "about": (f"{FIRM}.tagline", f"{DATA}.company_tagline", f"{FIRM_DATA}.tagline"),
    "exchange": (f"{FIRM}.stock_exchange", f"{FIRM_DATA}.stock_exchange"),
    "symbol": (f"{FIRM}.stock_symbol", f"{FIRM_DATA}.stock_symbol"),
    "seniority": (f"{DATA}.seniority_level",), "place": (f"{DATA}.formatted_workplace_location",), "workplace": (f"{DATA}.workplace_type", "$.workplace_type"), "sector": (f"{DATA}.company_sector_and_industry",),
}
APPLY = ("$.apply_url", "$.applyUrl", "$.applicationUrl", "$.externalApplyUrl", f"{JOB}.apply_url")
EMPLOYEES = (f"{FIRM}.nb_employees", f"{FIRM_DATA}.nb_employees", f"{FIRM}.employee_count", f"{FIRM_DATA}.employee_count")
#: Bands of pay in the order in which they are looked for, countries by their codes, degrees, and benefits by their flags.
BANDS = (("hourly", "/hr"), ("yearly", "/yr"), ("monthly", "/mo"), ("weekly", "/wk"), ("daily", "/day"), ("bi-weekly", "/biweekly"))
SYMBOLS = {"USD": "$", "US$": "$", "EUR": "€", "GBP": "£", "INR": "₹"}
COUNTRIES = {"IN": "India", "US": "United States", "GB": "United Kingdom", "CA": "Canada", "AU": "Australia"}
DEGREES = (("associates", "Associate's degree"), ("bachelors", "Bachelor's degree"), ("masters", "Master's degree"), ("doctorate", "Doctorate"))
BENEFITS = (
    ("401k_matching", "401(k) matching"), ("retirement_plan", "Retirement plan"), ("generous_parental_leave", "Parental leave"), ("tuition_reimbursement", "Tuition reimbursement"), ("generous_paid_time_off", "Generous PTO"),
    ("four_day_work_week", "Four-day work week"), ("relocation_assistance", "Relocation assistance"), ("visa_sponsorship", "Visa sponsorship"), ("military_veterans", "Military / veterans friendly"),
)


def texts(record: Column, path: str) -> Column:
    """The texts of a list at a path, decoded, without blanks and repetitions whatever their case; null if it is no list."""
    each = F.filter(F.transform(F.try_variant_get(record, path, "array<string>"), lambda x: decode_entities(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return let(each, lambda some: F.filter(some, lambda x, i: F.array_position(F.transform(some, lambda y: F.lower(y)), F.lower(x)) == i + 1))


def at(record: Column, path: str) -> Column:
    """What stands at a path as text, a list joined by commas; null if it is blank."""
    listed = F.array_join(F.filter(F.transform(F.try_variant_get(record, path, "array<string>"), lambda x: F.trim(x)), lambda x: x != ""), ", ")
    return F.nullif(F.trim(F.coalesce(listed, F.try_variant_get(record, path, "string"))), F.lit(""))


def first(record: Column, paths) -> Column:
    return F.coalesce(*[at(record, p) for p in paths], F.lit(""))


def number(record: Column, path: str) -> Column:
    """A positive number, also one written with commas; else null."""
    return let(F.replace(at(record, path), F.lit(","), F.lit("")).try_cast("double"), lambda n: F.when(n > 0, n))


def shown(n: Column, small_unit: Column) -> Column:
    """Hourly and daily amounts to the cent, others from a thousand on as k to one place, rounded half up."""
    cents, tenths = F.floor(n * 100 + 0.5), F.floor(n / 100 + 0.5)
    exact = F.when(n % 1 == 0, n.cast("long").cast("string")).otherwise(F.regexp_replace(F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")), r"\.00$", ""))
    short = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))), F.lit("k"))
    return F.when(small_unit, exact).when(n >= 1000, short).otherwise(F.floor(n + 0.5).cast("string"))


def salary(record: Column) -> Column:
    """The band that the record names, else the first one with an amount: one amount, a range, or an open end, with sign and unit."""
    code = F.upper(F.coalesce(at(record, f"{DATA}.listed_compensation_currency"), F.lit("USD")))
    sign = let(code, lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SYMBOLS.items() for x in p]), c), F.concat(c, F.lit(" "))))
    named = F.lower(F.coalesce(at(record, f"{DATA}.listed_compensation_frequency"), F.lit("")))
    end = lambda b, side: number(record, f"{DATA}['{b}_{side}_compensation']").alias(side)
    bands = F.array(*[F.struct(F.lit(b.replace("-", "")).alias("name"), F.lit(unit).alias("unit"), end(b, "min"), end(b, "max")) for b, unit in BANDS])
    some = lambda b: b["min"].isNotNull() | b["max"].isNotNull()

    def told(b: Column) -> Column:
        small = b["name"].isin("hourly", "daily")
        low, high = F.concat(sign, shown(b["min"], small)), F.concat(sign, shown(b["max"], small))
        amount = F.when(b["min"] == b["max"], low).when(b["min"].isNotNull() & b["max"].isNotNull(), F.concat(low, F.lit("-"), high)).when(b["min"].isNotNull(), F.concat(low, F.lit("+"))).when(b["max"].isNotNull(), F.concat(F.lit("up to "), high))
        return F.concat(amount, b["unit"])

    chosen = let(named, lambda name: let(bands, lambda all_: F.coalesce(F.get(F.filter(all_, lambda b: b["name"] == name), F.lit(0)), F.get(F.filter(all_, some), F.lit(0)))))
    return F.coalesce(let(chosen, told), F.lit(""))


def location(record: Column) -> Column:
    """The place as shown, else the first city with its country's name, else the first state and country."""

    def named(city: Column) -> Column:
        code = F.upper(F.regexp_extract(city, r",\s*([A-Za-z]{2})$", 1))
        country = F.try_element_at(F.create_map(*[F.lit(x) for p in COUNTRIES.items() for x in p]), code)
        return F.when(country.isNotNull(), F.concat(F.regexp_replace(city, r",\s*[A-Za-z]{2}$", ", "), country)).otherwise(city)

    city = let(F.get(texts(record, f"{DATA}.workplace_cities"), F.lit(0)), named)
    rest = F.concat_ws(", ", F.get(texts(record, f"{DATA}.workplace_states"), F.lit(0)), F.get(texts(record, f"{DATA}.workplace_countries"), F.lit(0)))
    return F.coalesce(F.nullif(decode_entities(first(record, PATHS["place"])), F.lit("")), city, rest)


def flagged(record: Column, path: str) -> Column:
    return F.coalesce(F.lower(at(record, path)).isin("true", "yes", "1"), F.lit(False))


def degrees(record: Column) -> Column:
    """(kind, line) of the degrees that are required or preferred, with their fields of study."""

    def kind(asked: Column) -> Column:
        return F.when(asked.contains("not mentioned") | asked.isin("", "none", "n/a"), None).when(asked.contains("prefer"), "preferred").when(asked.contains("require") | asked.isin("yes", "true"), "required")

    lines = []
    for level, label in DEGREES:
        asked = F.regexp_replace(F.lower(F.coalesce(at(record, f"{DATA}.{level}_degree_requirement"), F.lit(""))), "[_-]+", " ")
        fields = F.array_join(texts(record, f"{DATA}.{level}_degree_fields_of_study"), ", ")
        studied = let(fields, lambda f: F.when(f != "", F.concat(F.lit(" in "), f)).otherwise(""))
        line = lambda k: F.struct(k.alias("kind"), F.concat(F.lit(label), studied, F.lit(" ("), k, F.lit(")")).alias("line"))  # noqa: B023, E731
        lines.append(let(let(asked, kind), lambda k: F.when(k.isNotNull(), line(k))))  # noqa: B023
    return F.array_compact(F.array(*lines))


def of_kind(asked: Column, kind: str) -> Column:
    return F.transform(F.filter(asked, lambda x: x["kind"] == kind), lambda x: x["line"])


def benefits(record: Column) -> Column:
    return F.array_compact(F.array(*[F.when(flagged(record, f"{DATA}['{key}']"), label) for key, label in BENEFITS]))


def postings(rows: DataFrame, record: str) -> DataFrame:
    """rows with a JSON text `record` -> the posting's fields beside `id`. Text that is no JSON gives blank fields."""
    v = F.col("v")
    x = rows.select("id", F.try_parse_json(record).alias("v"))
    link = [let(at(v, p), lambda u: F.when(u.rlike("(?i)^https?://") & ~u.rlike(r"(?i)^https?://([^/]*\.)?hiring\.?cafe(\.com)?([/:?#]|$)"), u)) for p in APPLY]
    kind = F.regexp_replace(F.lower(F.split(F.coalesce(at(v, f"{DATA}.commitment"), at(v, "$.employmentType"), F.lit("")), ", ")[0]), "[_-]+", " ")
    industries = F.coalesce(*[F.nullif(F.array_join(texts(v, f"{p}.industries"), ", "), F.lit("")) for p in (FIRM, FIRM_DATA)], F.lit(""))
    kinds = (("full", "Full-time"), ("part", "Part-time"), ("contract", "Contract"), ("intern", "Internship"), ("temp", "Temporary"), ("freelance", "Freelance"), ("gig", "Freelance"))
    employment = let(kind, lambda kind: F.coalesce(*[F.when(kind.contains(k), name) for k, name in kinds], F.initcap(kind)))
    place = lambda work: F.when(F.lower(work).contains("remote"), "Remote").when(F.lower(work).contains("hybrid"), "Hybrid").when(F.lower(work).rlike("on[ -]?site"), "Onsite").when(F.lower(work).contains("field"), "Field").otherwise(F.concat(F.upper(F.left(work, F.lit(1))), F.substring(work, 2, 1000)))
    remote = let(first(v, PATHS["workplace"]), place)
    website = let(first(v, PATHS["website"]), lambda site: F.when(site == "", "").when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), F.regexp_replace(site, "^/+", ""))))
    listed = lambda exchange, symbol: F.when((exchange != "") & (symbol != ""), F.concat(exchange, F.lit(": "), symbol)).otherwise(F.coalesce(F.nullif(symbol, F.lit("")), exchange))
    f500 = let(first(v, PATHS["exchange"]), lambda exchange: let(first(v, PATHS["symbol"]), lambda symbol: listed(exchange, symbol)))
    education = let(degrees(v), lambda asked: F.array_join(F.concat(of_kind(asked, "required"), of_kind(asked, "preferred")), "; "))
    return x.select(
        "id", *[first(v, PATHS[k]).alias(k) for k in ("title", "company", "date", "category", "about", "seniority")], F.regexp_replace(strip_html(first(v, PATHS["description"])), r"^\s+|\s+$", "").alias("description"),
        location(v).alias("location"), salary(v).alias("salary"), employment.alias("employment"), remote.alias("remote"), F.coalesce(*link, F.lit("")).alias("apply_url"),
        website.alias("website"), f500.alias("f500"), F.coalesce(F.nullif(industries, F.lit("")), first(v, PATHS["sector"])).alias("sector"), F.coalesce(*[F.floor(number(v, p)) for p in EMPLOYEES], F.lit(0)).cast("long").alias("employees"),
        F.coalesce(F.floor(number(v, f"{DATA}.min_industry_and_role_yoe")), F.lit(0)).cast("long").alias("experience"), F.when(flagged(v, f"{DATA}.visa_sponsorship"), "yes").when(F.lower(at(v, f"{DATA}.visa_sponsorship")) == "false", "no").otherwise("").alias("visa"),
        F.coalesce(texts(v, f"{DATA}.technical_tools"), F.array().cast("array<string>")).alias("skills"), education.alias("education"), benefits(v).alias("benefits"),
    )


# Queries: records around the parts table, with fields in all the places where they may stand


def records(spark, d) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    when = lambda n, r, c: F.when(k % n == r, c)
    pay = F.round(price, 2)
    job = F.struct(when(3, 0, F.col("p_name")).alias("title"), when(3, 1, F.concat(F.lit(" "), "p_name")).alias("job_title_raw"), F.concat(F.lit("<p>A "), "p_type", F.lit("</p><ul><li>one</li></ul>")).alias("description"), when(5, 0, F.concat(F.lit("https://x.org/"), k.cast("string"))).alias("apply_url"))
    bands = [when(4, 0, pay).alias("hourly_min_compensation"), when(8, 0, pay + 10).alias("hourly_max_compensation"), when(4, 1, F.format_number(F.floor(price) * 50, 0)).alias("yearly_min_compensation"), when(4, 1, F.floor(price) * F.when(k % 8 == 1, 50).otherwise(75)).alias("yearly_max_compensation"), when(4, 2, F.floor(price)).alias("bi-weekly_max_compensation"), when(16, 3, F.lit(-5)).alias("daily_min_compensation")]
    degree = F.when(k % 5 == 0, "Required").when(k % 5 == 1, "preferred_by_team").when(k % 5 == 2, "Not_Mentioned").otherwise("")
    data = F.struct(
        when(3, 2, F.col("p_name")).alias("core_job_title"), *bands, when(7, 0, F.lit("gbp")).alias("listed_compensation_currency"), when(16, 8, F.lit("Yearly")).alias("listed_compensation_frequency"),
        F.array(F.concat(F.initcap("p_type"), F.when(k % 2 == 0, ", IN").otherwise(", FR")), F.lit("")).alias("workplace_cities"), when(6, 0, F.concat("p_brand", F.lit(" &amp;  Park"))).alias("formatted_workplace_location"),
        F.array(F.lower("p_type"), F.upper("p_type"), F.lit(" "), F.col("p_brand")).alias("technical_tools"), degree.alias("bachelors_degree_requirement"), F.array(F.col("p_brand"), F.lit(None)).alias("bachelors_degree_fields_of_study"), F.when(k % 2 == 0, "yes").otherwise("none").alias("doctorate_degree_requirement"),
        (k % 3 == 0).alias("visa_sponsorship"), F.when(k % 4 == 0, "Yes").otherwise("no").alias("401k_matching"), F.when(k % 2 == 0, "full_time").otherwise("Gig work").alias("commitment"), F.when(k % 3 == 0, "On-Site").when(k % 3 == 1, "fully remote").otherwise("campus").alias("workplace_type"), (k % 13).cast("string").alias("min_industry_and_role_yoe"),
    )
    firm = F.struct(when(2, 0, F.col("p_brand")).alias("name"), when(4, 0, F.concat(F.lit("//"), F.lower("p_brand"), F.lit(".com"))).alias("homepage_uri"), when(4, 0, F.lit("NYSE")).alias("stock_exchange"), when(2, 0, F.lit("ABC")).alias("stock_symbol"), (k % 9 * 100).alias("nb_employees"), F.array(F.lit("b"), F.lit("B"), F.lit("a")).alias("industries"))
    whole = F.struct(job.alias("job_information"), data.alias("v5_processed_job_data"), firm.alias("enriched_company_data"), F.lit("https://hiring.cafe/job/1").alias("apply_url"), F.concat("p_brand", F.lit(" Ltd")).alias("company"), F.lit("2024-05-01").alias("date"))
    return spread(table(spark, d, "part"), "p_partkey").select(k.alias("id"), F.when(k % 17 == 0, "{broken").otherwise(F.to_json(whole)).alias("record"))


def _shown(n: str, small: str) -> str:
    tenths = f"floor({n} / 100 + 0.5)::bigint"
    return f"case when {small} then case when {n} = floor({n}) then {n}::bigint::varchar else regexp_replace(printf('%d.%02d', floor({n} * 100 + 0.5)::bigint // 100, floor({n} * 100 + 0.5)::bigint % 100), '[.]00$', '') end when {n} >= 1000 then ({tenths} // 10)::varchar || case when {tenths} % 10 = 0 then '' else '.' || ({tenths} % 10)::varchar end || 'k' else floor({n} + 0.5)::bigint::varchar end"


_money = f"""case when k % 16 = 8 then '' when k % 4 = 0 then sign || {_shown('pay', 'true')} || case when k % 8 = 0 then '-' || sign || {_shown('(pay + 10)', 'true')} else '+' end || '/hr'
  when k % 4 = 1 then sign || {_shown('(whole * 50)', 'false')} || case when k % 8 = 1 then '' else '-' || sign || {_shown('(whole * 75)', 'false')} end || '/yr' when k % 4 = 2 then 'up to ' || sign || {_shown('whole', 'false')} || '/biweekly' else '' end"""
AGGREGATED = f"""r as (select p_partkey as k, p_name, p_type, p_brand, round(p_retailprice, 2)::double as pay, floor(p_retailprice)::double as whole, case when p_partkey % 7 = 0 then '£' else '$' end as sign, p_partkey % 17 <> 0 as good from part),
f as (select k as id, case when good then {_money} else '' end as salary,
  case when not good then '' when k % 5 = 0 then 'Bachelor''s degree in ' || p_brand || ' (required)' when k % 5 = 1 then '' else '' end as b1, case when good and k % 2 = 0 then 'Doctorate (required)' else '' end as d1, case when good and k % 5 = 1 then 'Bachelor''s degree in ' || p_brand || ' (preferred)' else '' end as b2,
  case when good then list_filter([case when k % 4 = 0 then '401(k) matching' end, case when k % 3 = 0 then 'Visa sponsorship' end], lambda x: x is not null) else [] end as benefits, * from r),
e as (select *, array_to_string(list_filter([b1, d1, b2], lambda x: x <> ''), '; ') as education from f)"""


@query(f"""with {AGGREGATED} select id, case when good then p_name else '' end as title, case when not good then '' when k % 2 = 0 then p_brand else p_brand || ' Ltd' end as company, case when good then '2024-05-01' else '' end as date, '' as category, '' as about, '' as seniority,
case when good then 'A ' || p_type || chr(10) || '• one' else '' end as description, case when not good then '' when k % 6 = 0 then p_brand || ' & Park' else array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || case when k % 2 = 0 then ', India' else ', FR' end end as location,
salary, case when not good then '' when k % 2 = 0 then 'Full-time' else 'Freelance' end as employment, case when not good then '' when k % 3 = 0 then 'Onsite' when k % 3 = 1 then 'Remote' else 'Campus' end as remote, case when good and k % 5 = 0 then 'https://x.org/' || k else '' end as apply_url,
case when good and k % 4 = 0 then 'https://' || lower(p_brand) || '.com' else '' end as website, case when not good then '' when k % 4 = 0 then 'NYSE: ABC' when k % 2 = 0 then 'ABC' else '' end as f500, case when good then 'b, a' else '' end as sector, case when good then k % 9 * 100 else 0 end as employees,
case when good then k % 13 else 0 end as experience, case when not good then '' when k % 3 = 0 then 'yes' else 'no' end as visa, case when not good then [] when lower(p_brand) = lower(p_type) then [lower(p_type)] else [lower(p_type), p_brand] end as skills, education, benefits from e""")
def src_aggregator_record(spark, d):
    return postings(records(spark, d), "record")


def of_records(spark, d):
    return records(spark, d).select("id", F.try_parse_json("record").alias("v"))


@query(f"with {AGGREGATED} select id, salary from e")
def fn_salary_aggregator(spark, d):
    return of_records(spark, d).select("id", salary(F.col("v")).alias("salary"))


@query(f"with {AGGREGATED} select id, list_filter([b1, d1], lambda x: x <> '') as required, list_filter([b2], lambda x: x <> '') as preferred from e")
def fn_education(spark, d):
    """Degrees that a record asks for, and those it prefers."""
    asked = of_records(spark, d).select("id", degrees(F.col("v")).alias("asked"))
    return asked.select("id", of_kind(F.col("asked"), "required").alias("required"), of_kind(F.col("asked"), "preferred").alias("preferred"))


@query(f"with {AGGREGATED} select id, benefits from e")
def fn_benefits(spark, d):
    return of_records(spark, d).select("id", benefits(F.col("v")).alias("benefits"))
