"""Fetched payloads to rows: postings and boards of nine providers, run outputs, metric series.

The payloads are JSON texts as the providers send them, made here from the listing table; the mappings read
them by schema, so that nothing but the fields asked for is parsed. Their SQL twins say what must come
out in terms of the listing table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.text import nz, strip_html, strip_sql
from harvestry.plans.views import listings, runs
from harvestry.registry import query

#: Postings in one page of a board.
PAGE = 50
BASE = f"""r as (select page_id, title, coalesce(s_company, '') as company, coalesce(s_location, '') as location, {strip_sql("'<p>' || description || '</p>'")} as description,
    url, employment, work_mode, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') as day, created_ms from listings)"""


def base(spark, d) -> DataFrame:
    rows = listings(spark, d)
    return rows.select(
        "page_id", "title", F.coalesce("s_company", F.lit("")).alias("company"), F.coalesce("s_location", F.lit("")).alias("location"), F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("html"),
        "url", "employment", "work_mode", F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd").alias("day"), "created_ms",
    )


def first(*columns) -> Column:
    """The first that is neither null nor blank, else a blank."""
    return F.coalesce(*[nz(c if isinstance(c, Column) else F.col(c)) for c in columns], F.lit(""))


def joined(items: Column) -> Column:
    return F.array_join(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""), ", ")


def posting(rows: DataFrame, **fields: Column) -> DataFrame:
    """page_id and the fields of a posting; those a provider does not send are blank."""
    names = ("title", "company", "description", "location", "employment", "date", "apply_url")
    return rows.select("page_id", *[fields.get(n, F.lit("")).alias(n) for n in names])


def parsed(rows: DataFrame, payload: Column, schema: str, *carry: str) -> DataFrame:
    """page_id, carry and `j`, the payload read by the schema."""
    return rows.select("page_id", *carry, payload.alias("payload")).select("page_id", *carry, F.from_json("payload", schema).alias("j"))


def expected(title="trim(title)", company="''", description="description", location="''", employment="''", date="''", apply_url="url") -> str:
    return f"with {BASE} select page_id, {title} as title, {company} as company, {description} as description, {location} as location, {employment} as employment, {date} as date, {apply_url} as apply_url from r"


@query(expected(company="trim(company)", location="coalesce(nullif(case when page_id % 2 = 0 then trim(location) end, ''), concat_ws(', ', nullif(location, ''), 'HQ'))", date="case when page_id % 3 = 0 then day || 'T00:00:00Z' else day end"), "listings")
def src_map_greenhouse(spark, d):
    rows = base(spark, d)
    offices = F.array(F.struct(F.col("location").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("HQ").alias("name")))
    payload = F.to_json(F.struct(F.concat(F.lit(" "), "title").alias("title"), F.col("html").alias("content"), F.when(F.col("page_id") % 2 == 0, F.struct(F.col("location").alias("name"))).alias("location"), offices.alias("offices"), F.when(F.col("page_id") % 3 == 0, F.concat("day", F.lit("T00:00:00Z"))).alias("updated_at"), F.col("day").alias("created_at"), F.col("url").alias("absolute_url")))
    j = parsed(rows, payload, "title string, content string, description string, location struct<name: string>, offices array<struct<name: string>>, updated_at string, created_at string, absolute_url string", "company", "url")
    return posting(j, title=F.trim("j.title"), company=F.trim("company"), description=strip_html(F.coalesce("j.content", "j.description", F.lit(""))), location=first("j.location.name", joined(F.col("j.offices.name"))), date=first("j.updated_at", "j.created_at"), apply_url=first("j.absolute_url", "url"))


@query(expected(company="trim(company)", location="concat_ws(', ', nullif(location, ''), 'Remote', 'Pune')", employment="trim(employment)", date="day"), "listings")
def src_map_workday(spark, d):
    """Further locations are names or objects with a name."""
    rows = base(spark, d)
    info = F.to_json(F.struct(F.struct("title", F.col("html").alias("jobDescription"), "location", F.col("day").alias("postedOn"), F.col("employment").alias("timeType")).alias("jobPostingInfo")))
    payload = F.concat(F.expr("substring(info, 1, length(info) - 2)"), F.lit(', "additionalLocations": ["Remote", {"name": "Pune"}, ""]}}'))
    j = parsed(rows.withColumn("info", info), payload, "jobPostingInfo struct<title: string, jobDescription: string, description: string, location: string, locationsText: string, additionalLocations: array<string>, startDate: string, postedOn: string, timeType: string>", "company", "url")
    more = F.transform("j.jobPostingInfo.additionalLocations", lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    j = j.withColumn("i", F.col("j.jobPostingInfo"))
    return posting(j, title=F.trim("i.title"), company=F.trim("company"), description=strip_html(F.coalesce("i.jobDescription", "i.description", F.lit(""))), location=joined(F.concat(F.array("i.location", "i.locationsText"), more)), employment=F.trim(first("i.timeType")), date=first("i.startDate", "i.postedOn"), apply_url=F.col("url"))


@query(expected(company="case when page_id % 4 = 0 then 'Own name' else trim(company) end", location="case when page_id % 2 = 0 then concat_ws(', ', nullif(location, ''), 'Oslo') else trim(location) end", employment="trim(employment)"), "listings")
def src_map_eightfold(spark, d):
    """The location is one name, or a list of names or objects; the posting may lie under `data` or `job`."""
    rows = base(spark, d)
    place = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("["), F.to_json(F.struct(F.col("location").alias("name"))), F.lit(', "Oslo"]'))).otherwise(F.concat(F.lit('"'), "location", F.lit('"')))
    job = F.to_json(F.struct(F.col("title").alias("name"), F.when(F.col("page_id") % 4 == 0, "Own name").alias("company"), F.col("html").alias("job_description"), F.col("employment").alias("type"), "url"))
    rows = rows.withColumn("job", job)
    payload = F.concat(F.when(F.col("page_id") % 3 == 0, '{"data":').otherwise('{"job":'), F.expr("substring(job, 1, length(job) - 1)"), F.lit(', "location": '), place, F.lit("}}"))
    kind = "struct<name: string, title: string, company: string, job_description: string, description: string, type: string, employment_type: string, url: string, location: string>"
    j = parsed(rows, payload, f"data {kind}, job {kind}", "company", "url").withColumn("i", F.coalesce("j.data", "j.job"))
    names = F.transform(F.from_json("i.location", "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    return posting(j, title=F.trim(first("i.name", "i.title")), company=first("i.company", "company"), description=strip_html(first("i.job_description", "i.description")), location=F.when(F.col("i.location").startswith("["), joined(names)).otherwise(F.trim(first("i.location"))), employment=F.trim(first("i.employment_type", "i.type")), apply_url=first("i.url", "url"))


@query(expected(company="trim(company)", location="coalesce(nullif(trim(location), ''), trim(work_mode))", employment="trim(employment)", date="strftime(make_timestamp(created_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'", description=strip_sql("'<p>' || description || '</p>' || chr(10) || chr(10) || 'More.'").replace("description", "(select l.description from listings l where l.page_id = r.page_id)", 1)), "listings")
def src_map_lever(spark, d):
    """The description has two parts; the time is in milliseconds."""
    rows = base(spark, d)
    payload = F.to_json(F.struct(F.col("title").alias("text"), F.col("html").alias("description"), F.lit("More.").alias("additionalPlain"), F.struct("location", F.col("employment").alias("commitment")).alias("categories"), F.col("work_mode").alias("workplaceType"), F.col("created_ms").alias("createdAt"), F.col("url").alias("hostedUrl")))
    j = parsed(rows, payload, "text string, title string, descriptionPlain string, description string, additionalPlain string, additional string, categories struct<location: string, commitment: string>, workplaceType string, createdAt long, hostedUrl string, applyUrl string", "company", "url")
    parts = F.concat_ws("\n\n", nz(F.coalesce("j.descriptionPlain", "j.description")), nz(F.coalesce("j.additionalPlain", "j.additional")))
    date = F.coalesce(F.date_format(F.timestamp_millis("j.createdAt"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    return posting(j, title=F.trim(first("j.text", "j.title")), company=F.trim("company"), description=strip_html(parts), location=F.trim(first("j.categories.location", "j.workplaceType")), employment=F.trim(first("j.categories.commitment")), date=date, apply_url=first("j.hostedUrl", "j.applyUrl", "url"))


@query(expected(title="case when page_id % 5 = 0 then 'First' else trim(title) end", company="'Org'", description="case when page_id % 5 = 0 then '' else description end", location="case when page_id % 5 = 0 then 'Rome, Bern' else trim(location) end", employment="case when page_id % 5 = 0 then '' else trim(employment) end", apply_url="case when page_id % 5 = 0 then 'https://first.example/1' else url end"), "listings")
def src_map_ashby(spark, d):
    """Of a board's postings the one with the id asked for, or whose URL holds it, else the first."""
    rows = base(spark, d)
    kind = "struct<id: string, jobId: string, title: string, descriptionHtml: string, location: string, secondaryLocations: array<struct<location: string>>, employmentType: string, jobUrl: string>"
    text = lambda v, n: (F.lit(v) if isinstance(v, str) else v).cast("string").alias(n)
    no = F.lit(None).cast("string")
    cities = F.array(*[F.struct(F.lit(c).alias("location")) for c in ("Rome", "", "Bern")])
    one = F.struct(text("first", "id"), text(no, "jobId"), text("First", "title"), text(no, "descriptionHtml"), text("", "location"), cities.alias("secondaryLocations"), text(no, "employmentType"), text("https://first.example/1", "jobUrl"))
    own = F.struct(text(F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("job-"), "page_id")).otherwise("other"), "id"), text(no, "jobId"), text(F.col("title"), "title"), text(F.col("html"), "descriptionHtml"), text(F.col("location"), "location"), F.lit(None).cast("array<struct<location: string>>").alias("secondaryLocations"), text(F.col("employment"), "employmentType"), text(F.col("url"), "jobUrl"))
    payload = F.to_json(F.struct(F.lit("Org").alias("organizationName"), F.array(one, own).alias("jobs")))
    j = parsed(rows, payload, f"organizationName string, jobs array<{kind}>", "company", "url")
    asked = F.concat(F.lit("job-"), F.col("page_id").cast("string"))
    found = F.filter("j.jobs", lambda x: F.coalesce((x["id"] == asked) | (x["jobId"] == asked) | x["jobUrl"].contains(asked), F.lit(False)))
    j = j.withColumn("i", F.coalesce(F.get(found, F.lit(0)), F.get("j.jobs", F.lit(0))))
    return posting(j, title=F.trim("i.title"), company=first("j.organizationName", "company"), description=strip_html(F.coalesce("i.descriptionHtml", F.lit(""))), location=first("i.location", joined(F.col("i.secondaryLocations.location"))), employment=F.trim(first("i.employmentType")), apply_url=first("i.jobUrl", "url"))


@query(expected(company="case when page_id % 2 = 0 then 'Dept' else trim(company) end", location="coalesce(nullif(case when page_id % 3 = 0 then trim(location) end, ''), 'NL')", employment="trim(employment)"), "listings")
def src_map_workable(spark, d):
    rows = base(spark, d)
    payload = F.to_json(F.struct("title", F.when(F.col("page_id") % 2 == 0, "Dept").alias("department"), F.col("html").alias("full_description"), F.struct(F.when(F.col("page_id") % 3 == 0, F.col("location")).alias("city"), F.lit("NL").alias("country")).alias("location"), F.col("employment").alias("employment_type"), "url"))
    j = parsed(rows, payload, "title string, department string, description string, full_description string, location struct<city: string, country: string>, employment_type string, url string", "company", "url")
    return posting(j, title=F.trim("j.title"), company=first("j.department", "company"), description=strip_html(first("j.description", "j.full_description")), location=first("j.location.city", "j.location.country"), employment=F.trim(first("j.employment_type")), apply_url=first("j.url", "url"))


@query(expected(company="coalesce(nullif(case when page_id % 2 = 0 then trim(company) end, ''), trim(company))", location="concat_ws(', ', nullif(location, ''), 'NW', 'DE')", employment="trim(employment)", date="day", apply_url="case when page_id % 3 = 0 then 'REF' || page_id else url end"), "listings")
def src_map_smartrecruiters(spark, d):
    rows = base(spark, d)
    text = F.struct(F.struct(F.struct(F.col("html").alias("text")).alias("jobDescription")).alias("sections"))
    payload = F.to_json(F.struct(F.col("title").alias("name"), F.when(F.col("page_id") % 2 == 0, F.struct(F.col("company").alias("name"))).alias("company"), text.alias("jobAd"), F.struct(F.col("location").alias("city"), F.lit("NW").alias("region"), F.lit("DE").alias("country")).alias("location"), F.struct(F.col("employment").alias("label")).alias("typeOfEmployment"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("REF"), "page_id")).alias("refNumber"), F.col("day").alias("releasedDate")))
    j = parsed(rows, payload, "name string, title string, company struct<name: string>, jobAd struct<sections: struct<jobDescription: struct<text: string>>>, description string, location struct<city: string, region: string, country: string>, typeOfEmployment struct<label: string>, applyUrl string, refNumber string, releasedDate string, createdOn string", "company", "url")
    return posting(j, title=F.trim(first("j.name", "j.title")), company=first("j.company.name", "company"), description=strip_html(F.coalesce("j.jobAd.sections.jobDescription.text", "j.description", F.lit(""))), location=joined(F.array("j.location.city", "j.location.region", "j.location.country")), employment=F.trim(first("j.typeOfEmployment.label")), date=first("j.releasedDate", "j.createdOn"), apply_url=first("j.applyUrl", "j.refNumber", "url"))


@query(expected(company="trim(company)", location="coalesce(nullif(trim(location), ''), 'Gent')", employment="trim(employment)", date="day"), "listings")
def src_map_recruitee(spark, d):
    """The offer may lie in an envelope."""
    rows = base(spark, d)
    offer = F.struct("title", F.col("html").alias("description"), "location", F.lit("Gent").alias("city"), F.col("employment").alias("employment_type"), F.col("day").alias("published_at"), F.col("url").alias("careers_url"))
    payload = F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct(offer.alias("offer")))).otherwise(F.to_json(offer))
    kind = "title string, description string, requirements string, location string, city string, employment_type_code string, employment_type string, published_at string, created_at string, careers_url string"
    rows = rows.select("page_id", "company", "url", payload.alias("payload"))
    inner = F.coalesce(F.get_json_object("payload", "$.offer"), F.col("payload"))
    j = parsed(rows, inner, kind, "company", "url")
    return posting(j, title=F.trim("j.title"), company=F.trim("company"), description=strip_html(F.coalesce("j.description", "j.requirements", F.lit(""))), location=first("j.location", "j.city"), employment=F.trim(first("j.employment_type_code", "j.employment_type")), date=first("j.published_at", "j.created_at"), apply_url=first("j.careers_url", "url"))


@query(f"with {BASE} select page_id, trim(title) as title, coalesce(nullif(trim(location), ''), 'Turin, IT') as location, case when contains(lower(work_mode), 'remote') then 'Remote' else '' end as remote, case when page_id % 40 between 1 and 30 then (page_id % 40)::bigint end as years, split_part(url, '?', 1) as apply_url from r", "listings")
def src_map_oracle(spark, d):
    """Flexible fields are prompts and values: the least years of experience are the largest number up to 30 that a prompt on it gives."""
    rows = base(spark, d)
    flex = F.array(F.struct(F.lit("Years of Experience").alias("Prompt"), F.concat((F.col("page_id") % 40).cast("string"), F.lit(" to 50+ years")).alias("Value")), F.struct(F.lit("Experience").alias("Prompt"), F.lit("  ").alias("Value")), F.struct(F.lit("Team").alias("Prompt"), F.lit("29").alias("Value")))
    where = F.struct(F.lit("Turin").alias("TownOrCity"), F.lit(None).cast("string").alias("Region2"), F.lit("IT").alias("Country"))
    payload = F.to_json(F.struct(F.array(F.struct(F.col("title").alias("Title"), F.col("location").alias("PrimaryLocation"), F.col("work_mode").alias("WorkplaceType"), flex.alias("requisitionFlexFields"), F.array(where).alias("workLocation"))).alias("items")))
    j = parsed(rows, payload, "items array<struct<Title: string, PrimaryLocation: string, WorkplaceType: string, requisitionFlexFields: array<struct<Prompt: string, Value: string>>, workLocation: array<struct<TownOrCity: string, Region2: string, Country: string>>>>", "url").withColumn("i", F.get("j.items", F.lit(0)))
    asked = F.filter("i.requisitionFlexFields", lambda x: F.lower(x["Prompt"]).rlike(r"\byears?\b|\bexperience\b") & (F.trim(x["Value"]) != ""))
    years = F.array_max(F.filter(F.transform(asked, lambda x: F.floor(F.regexp_extract(x["Value"], r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double"))), lambda n: (n > 0) & (n <= 30)))
    place = F.get("i.workLocation", F.lit(0))
    return j.select("page_id", F.trim("i.Title").alias("title"), first("i.PrimaryLocation", joined(F.array(place["TownOrCity"], place["Region2"], place["Country"]))).alias("location"), F.when(F.lower("i.WorkplaceType").contains("remote"), "Remote").otherwise("").alias("remote"), years.alias("years"), F.substring_index("url", "?", 1).alias("apply_url"))


# Boards: pages of up to PAGE postings


def board(rows: DataFrame, item: Column, envelope: str | None) -> DataFrame:
    """payload: one JSON text for each PAGE postings."""
    jobs = F.collect_list(item)
    return rows.groupBy(F.floor(F.col("page_id") / PAGE).alias("page")).agg(jobs.alias("jobs")).select(F.to_json(F.struct(F.col("jobs").alias(envelope)) if envelope else F.col("jobs")).alias("payload"))


def board_rows(payloads: DataFrame, schema: str, envelope: str | None, **fields: Column) -> DataFrame:
    """One row for each posting with a URL and a title."""
    read = F.from_json("payload", f"{envelope} array<struct<{schema}>>" if envelope else f"array<struct<{schema}>>")
    rows = payloads.select(F.explode(read[envelope] if envelope else read).alias("x"))
    names = ("job_url", "title", "location", "employment", "date", "department")
    return rows.select(*[F.trim(fields.get(n, F.lit(""))).alias(n) for n in names]).where("job_url <> '' and title <> ''")


def board_sql(job_url="url", title="trim(title)", location="''", employment="''", date="''", department="''") -> str:
    return f"with {BASE} select * from (select {job_url} as job_url, {title} as title, {location} as location, {employment} as employment, {date} as date, {department} as department from r) where job_url <> '' and title <> ''"


def sent(rows: DataFrame) -> DataFrame:
    """Every seventh posting lacks its title, every ninth its URL."""
    return rows.withColumn("title", F.when(F.col("page_id") % 7 != 0, F.col("title"))).withColumn("url", F.when(F.col("page_id") % 9 != 0, F.col("url")))


TITLE, URL = "case when page_id % 7 <> 0 then trim(title) else '' end", "case when page_id % 9 <> 0 then url else '' end"


@query(board_sql(URL, TITLE, location="coalesce(nullif(trim(location), ''), 'HQ')", date="day", department="'A, B'"), "listings")
def src_board_rows_greenhouse(spark, d):
    named = lambda *n: F.array(*[F.struct(F.lit(x).alias("name")) for x in n])
    item = F.struct("title", F.struct(F.col("location").alias("name")).alias("location"), named("HQ", "").alias("offices"), named("A", "", "B").alias("departments"), F.col("day").alias("created_at"), F.col("url").alias("absolute_url"))
    return board_rows(board(sent(base(spark, d)), item, "jobs"), "title: string, location: struct<name: string>, offices: array<struct<name: string>>, departments: array<struct<name: string>>, updated_at: string, created_at: string, absolute_url: string", "jobs", job_url=first("x.absolute_url"), title=first("x.title"), location=first("x.location.name", joined(F.col("x.offices.name"))), date=first("x.updated_at", "x.created_at"), department=joined(F.col("x.departments.name")))


@query(board_sql(URL, TITLE, location="coalesce(nullif(trim(location), ''), trim(work_mode))", employment="trim(employment)", date="strftime(make_timestamp(created_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'", department="'Team'"), "listings")
def src_board_rows_lever(spark, d):
    item = F.struct(F.col("title").alias("text"), F.struct("location", F.col("employment").alias("commitment"), F.lit("Team").alias("team")).alias("categories"), F.col("work_mode").alias("workplaceType"), F.col("created_ms").alias("createdAt"), F.col("url").alias("applyUrl"))
    return board_rows(board(sent(base(spark, d)), item, None), "text: string, title: string, categories: struct<location: string, commitment: string, team: string, department: string>, workplaceType: string, createdAt: long, hostedUrl: string, applyUrl: string", None, job_url=first("x.hostedUrl", "x.applyUrl"), title=first("x.text", "x.title"), location=first("x.categories.location", "x.workplaceType"), employment=first("x.categories.commitment"), date=F.coalesce(F.date_format(F.timestamp_millis("x.createdAt"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")), department=first("x.categories.team", "x.categories.department"))


@query(board_sql(URL, TITLE, location="coalesce(nullif(trim(location), ''), 'Rome, Bern')", employment="trim(employment)", department="'Team'"), "listings")
def src_board_rows_ashby(spark, d):
    cities = F.array(*[F.struct(F.lit(c).alias("location")) for c in ("Rome", "", "Bern")])
    item = F.struct("title", "location", cities.alias("secondaryLocations"), F.col("employment").alias("employmentType"), F.lit("Team").alias("teamName"), F.col("url").alias("jobUrl"))
    return board_rows(board(sent(base(spark, d)), item, "jobs"), "title: string, location: string, secondaryLocations: array<struct<location: string>>, employmentType: string, departmentName: string, teamName: string, jobUrl: string, applyUrl: string", "jobs", job_url=first("x.jobUrl", "x.applyUrl"), title=first("x.title"), location=first("x.location", joined(F.col("x.secondaryLocations.location"))), employment=first("x.employmentType"), department=first("x.departmentName", "x.teamName"))


@query(board_sql("case when page_id % 9 <> 0 then url else 'https://jobs.smartrecruiters.com/Acme/' || page_id end", TITLE, location="concat_ws(', ', nullif(location, ''), 'DE')", employment="trim(employment)", date="day"), "listings")
def src_board_rows_smartrecruiters(spark, d):
    """A posting without a URL gets one from the company and its id."""
    item = F.struct(F.col("page_id").cast("string").alias("id"), F.col("title").alias("name"), F.struct(F.col("location").alias("city"), F.lit("DE").alias("country")).alias("location"), F.struct(F.col("employment").alias("label")).alias("typeOfEmployment"), F.col("day").alias("createdOn"), F.col("url").alias("postingUrl"))
    made = F.concat(F.lit("https://jobs.smartrecruiters.com/Acme/"), F.url_encode("x.id"))
    return board_rows(board(sent(base(spark, d)), item, "content"), "id: string, name: string, title: string, location: struct<city: string, region: string, country: string>, typeOfEmployment: struct<label: string>, releasedDate: string, createdOn: string, applyUrl: string, postingUrl: string", "content", job_url=first("x.applyUrl", "x.postingUrl", made), title=first("x.name", "x.title"), location=joined(F.array("x.location.city", "x.location.region", "x.location.country")), employment=first("x.typeOfEmployment.label"), date=first("x.releasedDate", "x.createdOn"))


@query(board_sql("'https://careers.example.com/hcmUI/CandidateExperience/en/sites/S1/job/' || page_id", TITLE, location="trim(location)", employment="trim(employment)", date="day", department="'Fam'"), "listings")
def src_board_rows_oracle(spark, d):
    """The postings lie in the first of the answer's items."""
    item = F.struct(F.col("page_id").cast("string").alias("Id"), F.col("title").alias("Title"), F.col("location").alias("PrimaryLocation"), F.col("employment").alias("WorkerType"), F.col("day").alias("PostedDate"), F.lit("Fam").alias("JobFamily"))
    rows = sent(base(spark, d)).groupBy(F.floor(F.col("page_id") / PAGE).alias("page")).agg(F.collect_list(item).alias("requisitionList"))
    payloads = rows.select(F.get_json_object(F.to_json(F.struct(F.array(F.struct("requisitionList")).alias("items"))), "$.items[0]").alias("payload"))
    url = F.concat(F.lit("https://careers.example.com/hcmUI/CandidateExperience/en/sites/S1/job/"), F.url_encode("x.Id"))
    return board_rows(payloads, "Id: string, Title: string, PrimaryLocation: string, JobType: string, WorkerType: string, ContractType: string, PostedDate: string, JobFamily: string, JobFunction: string", "requisitionList", job_url=first(url), title=first("x.Title"), location=first("x.PrimaryLocation"), employment=first("x.JobType", "x.WorkerType", "x.ContractType"), date=first("x.PostedDate"), department=first("x.JobFamily", "x.JobFunction"))


#: Rows and pages that a board gives at most.
MOST_ROWS, MOST_PAGES = 5000, 200


@query(f"with {BASE} select page_id from r where page_id < {PAGE * MOST_PAGES} order by page_id limit {MOST_ROWS}", "listings")
def src_board_fetch_limits(spark, d):
    """The limit is the feature: a board is read up to so many pages and rows."""
    return base(spark, d).where(F.col("page_id") < PAGE * MOST_PAGES).orderBy("page_id").limit(MOST_ROWS).select("page_id")


# Run outputs and metric series


@query("""with a as (select run_id, 'scrapeList:jobs' as source, unnest(range(run_id % 3)) as n, 'row' as kind from runs), b as (select run_id, 'crawl:pages' as source, unnest(range(2)) as n, 'page' as kind from runs where run_id % 2 = 0),
    c as (select run_id, 'search:web' as source, unnest(range(run_id % 2 + 1)) as n, 'hit' as kind from runs where run_id % 5 = 0), e as (select run_id, 'scrapeSchema:one' as source, 0::bigint as n, 'one' as kind from runs where run_id % 7 = 0)
    select run_id, source, '{"kind":"' || kind || '","n":' || n || '}' as data from (select * from a union all select * from b union all select * from c union all select * from e)""", "runs")  # fmt: skip
def src_run_output_json(spark, d):
    """Rows of a run's output: buckets of named payloads, each a list, an object with `results`, an object of lists only, or one row."""
    made = lambda kind, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("n")))
    rid = F.col("run_id")
    none = F.array().cast("array<struct<kind: string, n: bigint>>")
    jobs = F.when(rid % 3 > 0, made("row", rid % 3)).otherwise(none)
    output = F.to_json(F.struct(
        F.struct(jobs.alias("jobs")).alias("scrapeList"),
        F.when(rid % 2 == 0, F.struct(F.struct(F.slice(made("page", F.lit(2).cast("long")), 1, 1).alias("a"), F.slice(made("page", F.lit(2).cast("long")), 2, 1).alias("b")).alias("pages"))).alias("crawl"),
        F.when(rid % 5 == 0, F.struct(F.struct(F.lit("q").alias("query"), made("hit", rid % 2 + 1).alias("results")).alias("web"))).alias("search"),
        F.when(rid % 7 == 0, F.struct(F.struct(F.lit("one").alias("kind"), F.lit(0).cast("long").alias("n")).alias("one"))).alias("scrapeSchema"),
    ))
    return output_rows(runs(spark, d).select("run_id", output.alias("output")))


def named_payloads(bucket: str) -> Column:
    return F.transform(F.map_entries(F.col(f"b.{bucket}")), lambda e: F.struct(F.concat(F.lit(f"{bucket}:"), e["key"]).alias("source"), e["value"].alias("payload")))


def output_rows(outputs: DataFrame) -> DataFrame:
    """run_id, output (JSON) -> run_id, source, data (JSON of a row)."""
    buckets = F.from_json("output", "scrapeSchema map<string,string>, scrapeList map<string,string>, crawl map<string,string>, search map<string,string>")
    read = outputs.select("run_id", buckets.alias("b"))
    named = F.flatten(F.array_compact(F.array(*map(named_payloads, ("scrapeSchema", "scrapeList", "crawl", "search")))))
    payloads = read.select("run_id", F.explode(named).alias("x")).select("run_id", "x.source", F.col("x.payload").alias("p"))
    fields = F.from_json("p", "map<string,string>")
    lists = F.coalesce(F.size(fields) > 0, F.lit(False)) & ~F.exists(F.map_values(fields), lambda v: ~F.coalesce(v.startswith("["), F.lit(False)))
    items = lambda c: F.from_json(c, "array<string>")
    rows = F.when(F.col("p").startswith("["), items("p")).when(F.get_json_object("p", "$.results").startswith("["), items(F.get_json_object("p", "$.results"))).when(lists, F.flatten(F.transform(F.map_values(fields), items))).otherwise(F.array("p"))
    return payloads.select("run_id", "source", F.explode(rows).alias("data"))


SERIES = "s as (select robot_id, at_ms // 1000 as t, max(rows_extracted) as v from runs group by 1, 2)"


@query(f"with {SERIES} select robot_id, t::double as t, v::double as v from s where t % 13 <> 0", "runs")
def src_prom_series(spark, d):
    """Points of a metric answer in order, those without a finite number left out."""
    points = runs(spark, d).groupBy("robot_id", F.floor(F.col("at_ms") / 1000).alias("t")).agg(F.max("rows_extracted").alias("v"))
    value = F.when(F.col("t") % 13 == 0, "NaN").otherwise(F.col("v").cast("string"))
    day = F.floor(F.col("t") / 86400)
    pair = F.array(F.col("t").cast("string"), value)
    answers = points.groupBy("robot_id", day.alias("day")).agg(F.to_json(F.struct(F.struct(F.array(F.struct(F.collect_list(pair).alias("values"))).alias("result")).alias("data"))).alias("answer"))
    read = F.from_json("answer", "data struct<result: array<struct<values: array<array<string>>>>>")
    rows = answers.select("robot_id", F.explode(F.flatten(read["data"]["result"]["values"])).alias("p"))
    rows = rows.select("robot_id", F.get("p", F.lit(0)).try_cast("double").alias("t"), F.get("p", F.lit(1)).try_cast("double").alias("v"))
    return rows.where(F.col("t").isNotNull() & F.col("v").isNotNull() & ~F.isnan("t") & ~F.isnan("v") & (F.abs("v") < float("inf"))).orderBy("robot_id", "t")
