"""Listing search, record keys, dedupe and shaping over the listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions.text import collapse, decode_entities, entities_sql, nz, snippet, strip_html
from harvestry.functions.urls import host, key, normalized, normalized_sql
from harvestry.plans.views import listings, table
from harvestry.registry import query
from harvestry.sources.storage import fresh_path

NOW_MS = 1705000000000
SHOWN = ("ats", "scrape.do", "browser", "list", "llm")


def visible(rows: DataFrame) -> DataFrame:
    """Ready listings from a known method with a description of 60 characters."""
    return rows.where((F.col("status") == "ready") & F.col("method").isin(*SHOWN) & (F.length("description") >= 60))


VIS = "vis as (select * from listings where status = 'ready' and method in ('ats','scrape.do','browser','list','llm') and length(description) >= 60)"


@query(f"with {VIS} select page_id from vis", "listings")
def flt_board_visible(spark, d):
    return visible(listings(spark, d)).select("page_id")


@query("select page_id, coalesce(nullif(company, ''), s_company, '') as company, coalesce(nullif(location, ''), s_location, '') as location, coalesce(nullif(category, ''), s_category, '') as category from listings", "listings")
def prj_coalesce_blank(spark, d):
    pick = lambda c: F.coalesce(nz(F.col(c)), F.col(f"s_{c}"), F.lit("")).alias(c)
    return listings(spark, d).select("page_id", pick("company"), pick("location"), pick("category"))


def facet(rows: DataFrame, name: str, k: int = 40) -> DataFrame:
    value = F.coalesce(nz(F.col(name)), F.col(f"s_{name}"))
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).where("value <> ''").orderBy(F.desc("n"), "value").limit(k).select(F.lit(name).alias("facet"), "value", "n")


@query(f"with {VIS}, f as (select unnest(['company','location','category']) as facet, unnest([coalesce(nullif(company, ''), s_company), coalesce(nullif(location, ''), s_location), coalesce(nullif(category, ''), s_category)]) as value from vis) select facet, value, n from (select *, row_number() over (partition by facet order by n desc, value) as k from (select facet, value, count(*) as n from f where value <> '' group by all)) where k <= 40", "listings")
def agg_facets_topk(spark, d):
    rows = visible(listings(spark, d))
    return facet(rows, "company").union(facet(rows, "location")).union(facet(rows, "category"))


@query("select status, count(*) as n from listings group by status", "listings")
def agg_board_status(spark, d):
    return listings(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("select s_company as company, count(*) as n from listings group by 1", "listings")
def agg_company_counts(spark, d):
    return listings(spark, d).groupBy(F.col("s_company").alias("company")).agg(F.count("*").alias("n"))


@query("select page_id from listings where lower(company) in ('thth', 'ththth', 'ththre') or lower(s_company) in ('thth', 'ththth', 'ththre')", "listings")
def flt_company_alias(spark, d):
    """A company under any of its names, on the row or the snapshot."""
    names = ("thth", "ththth", "ththre")
    return listings(spark, d).where(F.lower("company").isin(*names) | F.lower("s_company").isin(*names)).select("page_id")


@query("select page_id from listings where lower(category) = lower('Promo Brushed Tin') or lower(s_category) = (select lower(min(p_type)) from part)", "listings")
def flt_category(spark, d):
    first = table(spark, d, "part").agg(F.lower(F.min("p_type"))).scalar()
    return listings(spark, d).where((F.lower("category") == "promo brushed tin") | (F.lower("s_category") == first)).select("page_id")


@query("select page_id from listings where contains(lower(title), 'th') or contains(lower(company), 'th') or contains(lower(location), 'th') or contains(lower(category), 'th') or contains(lower(s_company), 'th')", "listings")
def flt_substring_q(spark, d):
    hit = F.lit(False)
    for c in ("title", "company", "location", "category", "s_company"):
        hit = hit | F.coalesce(F.lower(c).contains("th"), F.lit(False))
    return listings(spark, d).where(hit).select("page_id")


@query("with w as (select page_id, list_distinct(string_split_regex(lower(title), '[^a-z]+')) as t, list_distinct(string_split_regex(lower(coalesce(s_company, '')), '[^a-z]+')) as c, list_distinct(string_split_regex(lower(coalesce(s_location, '')), '[^a-z]+')) as l from listings) select page_id, score from (select page_id, 10 * len(list_intersect(t, q)) + 5 * len(list_intersect(c, q)) + 2 * len(list_intersect(l, q)) as score from w cross join (select ['the', 'and', 'thth', 'nation'] as q)) where score > 0", "listings")
def flt_text_search(spark, d):
    """Weighted word matches: title 10, company 5, location 2."""
    wanted = F.array(*map(F.lit, ("the", "and", "thth", "nation")))
    found = lambda c: F.size(F.array_intersect(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), wanted))
    score = 10 * found(F.col("title")) + 5 * found(F.col("s_company")) + 2 * found(F.col("s_location"))
    return listings(spark, d).select("page_id", score.cast("long").alias("score")).where("score > 0")


@query(f"select page_id from listings where created_ms >= {NOW_MS} - 604800000 and source = 'src0' and (regexp_matches(lower(work_mode), 'on[\\s-]*site') or regexp_matches(lower(employment), 'full[\\s-]*time'))", "listings")
def flt_board_filters(spark, d):
    return listings(spark, d).where((F.col("created_ms") >= NOW_MS - 604_800_000) & (F.col("source") == "src0") & (F.lower("work_mode").rlike(r"on[\s-]*site") | F.lower("employment").rlike(r"full[\s-]*time"))).select("page_id")


def loose(value: str) -> str:
    """A pattern for the value that ignores case, blanks and hyphens."""
    import re

    return "(?i)" + re.sub(r"(\\?[\s-])+", r"[\\s-]*", re.escape(value.strip()))


@query("select page_id, employment from listings where regexp_matches(lower(employment), 'part[\\s-]*time')", "listings")
def flt_loose_regex(spark, d):
    return listings(spark, d).where(F.col("employment").rlike(loose("Part-Time"))).select("page_id", "employment")


@query(f"select page_id, case when created_ms >= {NOW_MS} - 3600000 then '1h' when created_ms >= {NOW_MS} - 21600000 then '6h' when created_ms >= {NOW_MS} - 86400000 then '24h' when created_ms >= {NOW_MS} - 604800000 then '7d' else 'older' end as added from listings", "listings")
def flt_added_preset(spark, d):
    age = F.lit(NOW_MS) - F.col("created_ms")
    return listings(spark, d).select("page_id", F.when(age <= 3_600_000, "1h").when(age <= 21_600_000, "6h").when(age <= 86_400_000, "24h").when(age <= 604_800_000, "7d").otherwise("older").alias("added"))


@query("select page_id from listings where (source is null or source not in ('src0', 'src1')) and method not in ('', 'none')", "listings")
def flt_non_aggregator(spark, d):
    return listings(spark, d).where((F.col("source").isNull() | ~F.col("source").isin("src0", "src1")) & ~F.col("method").isin("", "none")).select("page_id")


@query("select page_id from listings where title <> '' and s_company <> '' and length(description) >= 400 and (location <> '' or source = 'src0')", "listings")
def flt_list_complete(spark, d):
    return listings(spark, d).where((F.col("title") != "") & (F.col("s_company") != "") & (F.length("description") >= 400) & ((F.col("location") != "") | (F.col("source") == "src0"))).select("page_id")


@query("select page_id from (select page_id, row_number() over (order by created_ms desc, page_id desc) as k from listings) where k <= 50", "listings")
def srt_board(spark, d):
    return listings(spark, d).orderBy(F.desc("created_ms"), F.desc("page_id")).limit(50).select("page_id")


@query("select page_id from listings where status = 'queued' order by case when method = 'ats' then 1 else 0 end desc, created_ms, page_id limit 8", "listings")
def srt_claim(spark, d):
    return listings(spark, d).where("status = 'queued'").orderBy((F.col("method") == "ats").desc(), "created_ms", "page_id").limit(8).select("page_id")


# Keys and dedupe. Each page's URL is seen in four spellings.

SEEN_SQL = """seen as (select page_id, pos, case pos when 0 then url when 1 then url || case when contains(url, '?') then '&' else '?' end || 'utm_source=x' when 2 then regexp_replace(url, '^(https?://)', '\\1www.')
    else upper(left(url, 4)) || substr(url, 5) end as raw from listings cross join (select unnest([0, 1, 2, 3]) as pos))"""


def seen(spark, d) -> DataFrame:
    url = F.col("url")
    forms = F.array(url, F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_source=x")), F.regexp_replace(url, "^(https?://)", "$1www."), F.concat(F.upper(F.substring(url, 1, 4)), url.substr(F.lit(5), F.length(url))))
    return listings(spark, d).select("page_id", F.posexplode(forms).alias("pos", "raw"))


@query(f"with {SEEN_SQL} select page_id, pos, {normalized_sql('raw')} as url from seen", "listings")
def fn_url_normalize(spark, d):
    return seen(spark, d).select("page_id", "pos", normalized(F.col("raw")).alias("url"))


@query(f"with {SEEN_SQL} select page_id, pos, sha256({normalized_sql('raw')}) as url_key from seen", "listings")
def dd_url_key(spark, d):
    return seen(spark, d).select("page_id", "pos", key(F.col("raw")).alias("url_key"))


@query("select page_id, nullif(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', ''), '') as host from listings", "listings")
def fn_url_host(spark, d):
    return listings(spark, d).select("page_id", host(F.col("url")).alias("host"))


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


@query(f"with {SEEN_SQL}, k as (select page_id, pos, {normalized_sql('raw')} as url from seen) select url, page_id, pos from (select *, row_number() over (partition by url order by page_id, pos) as n from k) where n = 1", "listings")
def dd_first_wins(spark, d):
    return first_by(fn_url_normalize(spark, d), ["url"], "page_id", "pos").select("url", "page_id", "pos")


@query(f"with {SEEN_SQL}, k as (select page_id, pos, {normalized_sql('raw')} as url from seen) select url, page_id, pos from (select *, row_number() over (partition by url order by page_id desc, pos desc) as n from k) where n = 1", "listings")
def dd_last_wins(spark, d):
    rows = fn_url_normalize(spark, d)
    return rows.groupBy("url").agg(F.max(F.struct("page_id", "pos")).alias("x")).select("url", "x.page_id", "x.pos")


@query(f"with {SEEN_SQL}, k as (select {normalized_sql('raw')} as url from seen) select count(*) as groups from (select url from k group by url having count(*) >= 2)", "listings")
def agg_path_dupes(spark, d):
    return fn_url_normalize(spark, d).groupBy("url").agg(F.count("*").alias("n")).where("n >= 2").agg(F.count("*").alias("groups"))


@query("select page_id, sha256(concat_ws(chr(10), trim(title), trim(coalesce(s_company, '')), trim(description), trim(coalesce(s_location, '')), '$' || (page_id % 90 + 40) || 'K / year', trim(employment), trim(work_mode), trim(url))) as hash from listings", "listings")
def dd_content_hash(spark, d):
    """Digest of the eight fields that make up a listing's content, in order; blanks count as empty."""
    fields = [F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "s_company", "description", "s_location", "salary", "employment", "work_mode", "url")]
    pay = F.concat(F.lit("$"), (F.col("page_id") % 90 + 40).cast("string"), F.lit("K / year"))
    return listings(spark, d).withColumn("salary", pay).select("page_id", F.sha2(F.concat_ws("\n", *fields), 256).alias("hash"))


@query("select min(doc_id) as doc_id, count(*) as n from documents group by text, lang")
def dd_exact_row(spark, d):
    """Rows alike in all compared columns: grouped by a fingerprint of their key-sorted JSON, first wins."""
    print_ = F.sha2(F.to_json(F.struct("lang", "text")), 256)
    return table(spark, d, "documents").groupBy(print_.alias("p")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("p")


@query("select min(doc_id) as doc_id, count(*) as n from (select doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) as t from documents) where t <> '' group by t")
def dd_norm_row(spark, d):
    t = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " "))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).where("t <> ''").groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("t")


@query("select page_id, coalesce(words, []) as words from listings left join (select page_id, list(w order by first_pos) as words from (select page_id, arg_min(w, pos) as w, min(pos) as first_pos from (select page_id, unnest(w) as w, generate_subscripts(w, 1) as pos from (select page_id, string_split(title, ' ') as w from listings)) where w <> '' group by page_id, lower(w)) group by page_id) using (page_id)", "listings")
def dd_ci_list(spark, d):
    """Words as they stand, each once whatever its case: the first spelling, in the first order."""
    new = lambda seen, w: F.when((w == "") | F.exists(seen, lambda x: F.lower(x) == F.lower(w)), seen).otherwise(F.array_append(seen, w))
    return listings(spark, d).select("page_id", F.aggregate(F.split("title", " "), F.array().cast("array<string>"), new).alias("words"))


WIN_SQL = """sc as (select s_company, page_id, status, description, location, employment, case status when 'ready' then 100 when 'partial' then 50 else 0 end + least(length(description), 5000) / 50.0 + case when location <> '' then 20 else 0 end + case when employment <> '' then 5 else 0 end as score from listings where s_company is not null),
    rk as (select *, row_number() over w as n, last_value(nullif(location, '')) over w as x from sc window w as (partition by s_company order by score desc, page_id)),
    wn as (select * from rk where n = 1),
    ls as (select s_company, arg_max(location, n) filter (where location <> '') as l_location, arg_max(employment, n) filter (where employment <> '') as l_employment, count(*) as losers from rk where n > 1 group by s_company),
    ld as (select r.s_company, arg_max(r.page_id, r.n) as from_page from rk r join wn using (s_company) where r.n > 1 and length(r.description) > length(wn.description) group by r.s_company)"""


@query(f"with {WIN_SQL} select s_company, page_id, coalesce(nullif(location, ''), l_location, '') as location, coalesce(nullif(employment, ''), l_employment, '') as employment, coalesce(losers, 0) as losers, coalesce(from_page, page_id) as description_from from wn left join ls using (s_company) left join ld using (s_company)", "listings")
def win_dedupe_score(spark, d):
    """The row of highest score stays; its blanks take the last loser's values, its description the last longer one."""
    score = F.expr("case status when 'ready' then 100 when 'partial' then 50 else 0 end + least(length(description), 5000) / 50.0 + if(location <> '', 20, 0) + if(employment <> '', 5, 0)")
    w = Window.partitionBy("s_company").orderBy(F.desc("score"), "page_id")
    rows = listings(spark, d).where("s_company is not null").withColumn("score", score).withColumn("n", F.row_number().over(w))
    rows = rows.withColumn("longest", F.first(F.length("description")).over(w)).withColumn("size", F.length("description"))
    lost = F.col("n") > 1
    last = lambda c: F.max_by(c, F.when(lost & (F.col(c) != ""), F.col("n")))
    out = rows.groupBy("s_company").agg(
        F.min_by("page_id", "n").alias("page_id"), F.min_by("location", "n").alias("w_location"), F.min_by("employment", "n").alias("w_employment"),
        F.coalesce(last("location"), F.lit("")).alias("l_location"), F.coalesce(last("employment"), F.lit("")).alias("l_employment"),
        F.count_if(lost).alias("losers"), F.max_by("page_id", F.when(lost & (F.col("size") > F.col("longest")), F.col("n"))).alias("from_page"),
    )
    return out.select("s_company", "page_id", F.coalesce(nz(F.col("w_location")), "l_location").alias("location"), F.coalesce(nz(F.col("w_employment")), "l_employment").alias("employment"), "losers", F.coalesce("from_page", "page_id").alias("description_from"))


#: Two-letter codes of the months in job numbers.
MONTHS = ("JA", "FE", "MR", "AP", "MY", "JN", "JL", "AU", "SE", "OC", "NO", "DE")
_months = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
JOBID_SQL = f"""base as (select page_id, case when len(w) >= 2 then upper(case when regexp_matches(w[1][1], '[a-zA-Z]') then w[1][1] else 'X' end || case when regexp_matches(w[2][1], '[a-zA-Z]') then w[2][1] else 'X' end)
    when len(w) = 1 and length(regexp_replace(w[1], '[^a-zA-Z0-9]', '', 'g')) >= 2 then upper(left(regexp_replace(w[1], '[^a-zA-Z0-9]', '', 'g'), 2)) when len(w) = 1 and length(regexp_replace(w[1], '[^a-zA-Z0-9]', '', 'g')) = 1 then upper(regexp_replace(w[1], '[^a-zA-Z0-9]', '', 'g') || 'X') else 'XX' end
    || strftime(make_timestamp(created_ms * 1000), '%d') || {_months}[month(make_timestamp(created_ms * 1000))] as base from (select *, list_filter(string_split_regex(trim(title), '\\s+'), lambda x: x <> '') as w from listings))"""


def base_key(title, day):
    """Two letters of the title's first words, day and month code."""
    w = F.filter(F.split(F.trim(title), r"\s+"), lambda x: x != "")
    one = F.regexp_replace(F.try_element_at(w, F.lit(1)), "[^a-zA-Z0-9]", "")
    letter = lambda i: F.when(F.substring(w[i], 1, 1).rlike("[a-zA-Z]"), F.substring(w[i], 1, 1)).otherwise("X")
    code = F.when(F.size(w) >= 2, F.upper(F.concat(letter(0), letter(1)))).when((F.size(w) == 1) & (F.length(one) >= 2), F.upper(F.substring(one, 1, 2))).when((F.size(w) == 1) & (F.length(one) == 1), F.upper(F.concat(one, F.lit("X")))).otherwise("XX")
    return F.concat(code, F.lpad(F.dayofmonth(day).cast("string"), 2, "0"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)))


def created_day():
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_ms") / 86_400_000).cast("int"))


@query(f"with {JOBID_SQL} select page_id, base from base", "listings")
def fn_job_base_key(spark, d):
    return listings(spark, d).select("page_id", base_key(F.col("title"), created_day()).alias("base"))


@query(f"with {JOBID_SQL} select page_id, base || lpad((row_number() over (partition by base order by page_id))::varchar, 3, '0') as job_id from base", "listings")
def win_job_id_seq(spark, d):
    n = F.row_number().over(Window.partitionBy("base").orderBy("page_id")).cast("string")
    return fn_job_base_key(spark, d).select("page_id", F.concat("base", F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)).alias("job_id"))


# Text


_refs = "title || case page_id % 5 when 0 then ' R&amp;D &MDASH; a&ndash;b' when 1 then ' caf&#xE9; &#8217;s &#x1F600;' when 2 then ' &amp;#65; &lt;b&gt; &#39;q&apos; &quot;' when 3 then '&nbsp; &unknown; &#;' else '' end"


@query(f"select page_id, {entities_sql('t')} as title from (select page_id, {_refs} as t from listings)", "listings")
def fn_html_entities(spark, d):
    return listings(spark, d).select("page_id", decode_entities(F.expr(_refs)).alias("title"))


@query("select page_id, case when length(t) > 280 then rtrim(left(t, 279)) || '…' else t end as snippet from (select page_id, trim(regexp_replace(description, '\\s+', ' ', 'g')) as t from listings)", "listings")
def fn_snippet(spark, d):
    return listings(spark, d).select("page_id", snippet(F.col("description")).alias("snippet"))


@query("select page_id, regexp_matches(html, '<[a-zA-Z][^>]*>') as html, regexp_matches(title, '<[a-z]+>') as title_html from (select p.page_id, p.html, l.title from pages p join listings l using (page_id))", "listings")
def fn_looks_html(spark, d):
    return table(spark, d, "pages").join(listings(spark, d).select("page_id", "title"), "page_id").select("page_id", F.col("html").rlike("<[a-zA-Z][^>]*>").alias("html"), F.col("title").rlike("<[a-z]+>").alias("title_html"))


_strip = "regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
_strip = f"regexp_replace({_strip}, '(?i)<li[^>]*>', chr(10) || '• ', 'g')"
_strip = f"regexp_replace({_strip}, '(?i)<br ?/?>|</(p|div|h[1-6]|li|ul|ol|tr)>', chr(10), 'g')"
_strip = f"regexp_replace(regexp_replace({_strip}, '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g')"
_strip = f"trim(regexp_replace({_strip}, ' ?\\n[ \\n]*', chr(10), 'g'))"


@query(f"select page_id, {_strip} as text from pages")
def fn_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


@query(f"select page_id, case when regexp_matches(html, '<[a-z]') then {_strip} else html end as text from pages")
def fn_norm_description(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.when(h.rlike("<[a-z]"), strip_html(h)).otherwise(h).alias("text"))


#: What a posting's text says, what site navigation, teasers and employers' own praise say.
SIGNAL = r"(?i)responsibilit|requirement|qualification|about\s+(?:the\s+)?(?:role|job|position)|what\s+you.?ll|you\s+will|we\s+(?:are\s+)?looking|benefits|experience\s+(?:required|preferred)|job\s+description|key\s+duties|who\s+you\s+are"
STRONG = r"(?i)responsibilit|requirements?|qualifications?|minimum qualifications?|preferred qualifications?|you will\b|what you.?ll\b|job description|key duties|we are looking|experience (?:required|preferred)"
BODY = r"(?i)responsibilit|requirements?|qualifications?|minimum qualifications?|preferred qualifications?|about\s+(?:the\s+)?(?:role|job|position)|what you.?ll do|job description|key duties|we are looking"
TEASERS = (r"(?is)apply for (?:a|an|the)\s+.{5,200}?\s+(?:job|role|position|opening)\s+at\b", r"(?is)(?:read about|learn more about)\s+(?:the|this)\s+role\b.{0,60}(?:find out|see if|right for you)")
CHROME = r"(?i)home\s*>|former\s+former|explore\s+explore|cookie\s+policy|privacy\s+policy|all\s+rights\s+reserved|terms\s+(?:of\s+)?(?:use|service)|skip\s+to\s+(?:main\s+)?content|accept\s+(?:all\s+)?cookies|sign\s+in\s+create\s+account|keyword\(s\)|radius\s+unit|\bradius\s+\d+|search\s+(?:carrier\s+)?jobs\b|search\s+jobs\s+search\s+jobs|select\s+(?:a\s+)?(?:category|location|communications|job\s+category)|browse\s+available\s+job\s+openings"
PRAISE = r"(?i)overview\s+who\s+we\s+are\s+collaborative\.?\s*respectful|a\s+place\s+to\s+dream\s+and\s+do"
LINKISH = r"(?i)\b(?:home|about|careers|contact|blog|news|login|apply now)\b"
# Documents as descriptions, with what postings and chrome say put before some of them.
SAID = ("You will own it. Key duties: ", "Privacy Policy. ", "Apply for the Senior Baker job at Acme. ", "former former former former ", "explore explore explore explore explore ", "Home about careers contact blog news login apply now home about ", "A place to dream and do. ", "", "Responsibilities: A place to dream and do ")
_said = "[" + ", ".join(f"'{x}'" for x in SAID) + f"][doc_id % {len(SAID)} + 1]"
JUNKED = f"""raw as (select doc_id, trim(regexp_replace({_said} || coalesce(text, ''), '[ \\t]+', ' ', 'g')) as t from documents), w as (select *, list_filter(string_split_regex(lower(t), '[ \\t\\n\\r]+'), lambda x: x <> '') as w from raw),
    junked as (select doc_id, t, length(t) < 40 or (regexp_matches(t, '{CHROME}') and not regexp_matches(t, '{BODY}')) or regexp_matches(t, '{TEASERS[0]}') or regexp_matches(t, '{TEASERS[1]}') or (length(t) < 280 and not regexp_matches(t, '{STRONG}'))
    or (regexp_matches(t, '{PRAISE}') and (not regexp_matches(t, '{SIGNAL}') or (length(t) < 900 and not regexp_matches(t, '(?i)\\bresponsibilit|\\bqualifications?\\b|\\brequirements?\\b')))) or (len(w) > 80 and len(list_distinct(w)) * 100 < 28 * len(w))
    or len(regexp_extract_all(t, '(?i)\\bformer\\b')) >= 4 or (len(regexp_extract_all(t, '(?i)\\bexplore\\b')) >= 5 and not regexp_matches(t, '{SIGNAL}')) or (length(t) > 1200 and not regexp_matches(t, '{SIGNAL}') and len(regexp_extract_all(t, '{LINKISH}')) >= 8) as junk from w),
    scored as (select doc_id, t, junk, case when junk then 0 else least(length(t), 4000) / 40.0 + case when regexp_matches(t, '{SIGNAL}') then 40 else 0 end + case when contains(t, chr(10)) or regexp_matches(t, '•|\\*|-\\s+\\w') then 10 else 0 end - case when length(t) > 8000 then 20 else 0 end end as score from junked)"""


def described(spark, d) -> DataFrame:
    """doc_id, t (the text of a posting's page), junk (navigation, a teaser, praise or repetition instead of a posting), score."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.concat(said, F.coalesce("text", F.lit(""))), r"[ \t]+", " ")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split(F.lower("t"), r"[ \t\n\r]+"), ""))
    rows = rows.withColumn("signal", F.col("t").rlike(SIGNAL))
    t, n, words, signal = F.col("t"), F.length("t"), F.size("w"), F.col("signal")
    often = lambda pattern: F.regexp_count(t, F.lit(pattern))
    junk = (
        (n < 40) | (t.rlike(CHROME) & ~t.rlike(BODY)) | t.rlike(TEASERS[0]) | t.rlike(TEASERS[1]) | ((n < 280) & ~t.rlike(STRONG))
        | (t.rlike(PRAISE) & (~signal | ((n < 900) & ~t.rlike(r"(?i)\bresponsibilit|\bqualifications?\b|\brequirements?\b")))) | ((words > 80) & (F.size(F.array_distinct("w")) * 100 < words * 28))
        | (often(r"(?i)\bformer\b") >= 4) | ((often(r"(?i)\bexplore\b") >= 5) & ~signal) | ((n > 1200) & ~signal & (often(LINKISH) >= 8))
    )
    rows = rows.select("doc_id", "t", "signal", junk.alias("junk"))
    shape = t.contains("\n") | t.rlike(r"•|\*|-\s+\w")
    score = F.least(n, F.lit(4000)) / 40.0 + F.when(signal, 40).otherwise(0) + F.when(shape, 10).otherwise(0) - F.when(n > 8000, 20).otherwise(0)
    return rows.withColumn("score", F.when(F.col("junk"), 0.0).otherwise(score)).drop("signal")


@query(f"with {JUNKED} select doc_id, junk from scored")
def fn_junk_description(spark, d):
    return described(spark, d).select("doc_id", "junk")


@query(f"with {JUNKED} select doc_id, score from scored")
def fn_quality_score(spark, d):
    return described(spark, d).select("doc_id", "score")


@query(f"with {JUNKED}, p as (select a.doc_id, a.t as ta, a.score as sa, coalesce(b.t, '') as tb, coalesce(b.score, 0) as sb from scored a left join scored b on b.doc_id = a.doc_id + 1) select doc_id, md5(case when sa = 0 and sb = 0 then case when ta = '' then tb when tb = '' then ta when length(ta) <= length(tb) then ta else tb end when sa >= sb then ta else tb end) as best from p")
def fn_best_description(spark, d):
    """The better of a description and its fallback, the next document's; of two junk ones the shorter that is not blank.

    The choice takes scores and lengths, and only a digest comes out: texts are scored once, where they are read, and stay there.
    """
    x = described(spark, d).select("doc_id", F.struct("score", F.length("t").alias("n"), F.md5("t").alias("digest")).alias("x"))
    # Each document stands as itself and as the fallback of the one before.
    roles = F.array(F.struct("doc_id", F.col("x").alias("own"), F.lit(None).alias("other")), F.struct((F.col("doc_id") - 1).alias("doc_id"), F.lit(None).alias("own"), F.col("x").alias("other")))
    p = x.select(F.inline(roles)).where("own is not null or doc_id is not null").groupBy("doc_id").agg(F.collect_list("own").alias("own"), F.collect_list("other").alias("other"))
    p = p.select("doc_id", F.explode("own").alias("own"), "other").select("doc_id", "own", F.explode_outer("other").alias("other"))
    p = p.select("doc_id", "own", F.coalesce("other", F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n"), F.md5(F.lit("")).alias("digest"))).alias("other"))
    shorter = F.when((F.col("own.n") > 0) & ((F.col("other.n") == 0) | (F.col("own.n") <= F.col("other.n"))), F.col("own.digest")).otherwise(F.col("other.digest"))
    best = F.when((F.col("own.score") == 0) & (F.col("other.score") == 0), shorter).when(F.col("own.score") >= F.col("other.score"), F.col("own.digest")).otherwise(F.col("other.digest"))
    return p.select("doc_id", best.alias("best"))


#: The paths whose slug is a title, in order of precedence; titles that name no posting; kinds of employment.
SLUGS = (r"(?i)/job/[^/]+/([^/]+)/[0-9]+/[0-9]+/?$", r"(?i)/job/[0-9]+/([^/]+)/?$", r"(?i)/jobs/results/[0-9]+-([^/?#]+)", r"(?i)/(?:careers|jobs)/listing/([^/]+)/[0-9]+/?$")
GENERIC = r"(?i)^(?:working\s+at\b.*|careers?\s+at\b.*|search\s+our\s+job\s+opportunities\b.*|saved\s+jobs|candidate\s+hub|inclusion|carrier\s+events|the\s+carrier\s+way|jobs?\s+at\b.*|general\s+privacy\s+notice\b.*|privacy[- ]?notice\b.*|job\s+details?|untitled(?:\s+role)?|careers?|google\s+careers?|apply\s+now|service\s+technicians|viessmann\s+climate\s+solutions|building\s+a\s+world\s+of\s+opportunity|browse\s+available\s+job\s+openings.*)$"
EMPLOYMENT = (("FULL_TIME", "Full-time"), ("PART_TIME", "Part-time"), ("CONTRACTOR", "Contract"), ("TEMPORARY", "Temporary"), ("INTERN", "Internship"), ("INTERNSHIP", "Internship"), ("VOLUNTEER", "Volunteer"), ("OTHER", "Other"))
_posting = "case page_id % 6 when 0 then 'https://careers.x.com/job/london/senior-qa-engineer/12/' || page_id when 1 then 'https://a.com/en/job/' || page_id || '/Team-lead-IT/' when 2 then 'https://google.com/jobs/results/' || page_id || '-staff-ux-writer?hl=en' when 3 then 'http://b.com/careers/listing/data--analyst-2/' || page_id when 4 then url else 'not a url' end"
_titles = "case page_id % 7 when 0 then 'Careers at ' || title when 1 then '' when 2 then 'QA' when 3 then ' Job  details ' when 4 then 'Staff writer for UX' else title end"
_slug = "coalesce(" + ", ".join(f"nullif(regexp_extract(regexp_extract(posting, '^https?://[^/?#]+([^?#]*)', 1), '{x}', 1), '')" for x in SLUGS) + ", '')"
_from_url = f"array_to_string(list_transform(list_filter(string_split({_slug}, '-'), lambda w: w <> ''), lambda w: case when regexp_full_match(w, '[0-9]+') then w when length(w) <= 2 then upper(w) else upper(w[1]) || lower(substr(w, 2)) end), ' ')"
_generic = f"length(t) < 3 or regexp_matches(t, '{GENERIC}')"
TITLED = f"titled as (select page_id, posting, t, {_from_url} as from_url, {_generic} as generic from (select page_id, {_posting} as posting, trim(regexp_replace({_titles}, '\\s+', ' ', 'g')) as t from listings))"


def titled(spark, d) -> DataFrame:
    """page_id, posting (a URL), t (a scraped title), from_url (the title that the URL's slug has), generic (whether t names no posting)."""
    rows = listings(spark, d).select("page_id", F.expr(_posting).alias("posting"), collapse(F.expr(_titles)).alias("t"))
    path = F.regexp_extract("posting", r"^https?://[^/?#]+([^?#]*)", 1)
    slug = F.coalesce(*[F.nullif(F.regexp_extract(path, x, 1), F.lit("")) for x in SLUGS], F.lit(""))
    words = F.filter(F.split(slug, "-"), lambda w: w != "")
    name = F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), w).when(F.length(w) <= 2, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))))
    return rows.withColumn("from_url", F.array_join(name, " ")).withColumn("generic", (F.length("t") < 3) | F.col("t").rlike(GENERIC))


@query(f"with {TITLED} select page_id, from_url as title from titled", "listings")
def fn_title_from_url(spark, d):
    return titled(spark, d).select("page_id", F.col("from_url").alias("title"))


@query(f"with {TITLED} select page_id, generic from titled", "listings")
def fn_generic_title(spark, d):
    return titled(spark, d).select("page_id", "generic")


@query(f"with {TITLED}, w as (select *, list_filter(string_split(lower(from_url), ' '), lambda x: length(x) > 2 and x not in ('and', 'the', 'for', 'with', 'from')) as words from titled) select page_id, case when from_url = '' then t when generic then from_url when len(words) = 0 then t when len(list_filter(words, lambda x: contains(lower(t), x))) < least(2, len(words)) then from_url else t end as title from w", "listings")
def fn_prefer_url_title(spark, d):
    """The slug's title where the scraped one is generic or shares fewer than two of its words."""
    words = F.filter(F.split(F.lower("from_url"), " "), lambda x: (F.length(x) > 2) & ~x.isin("and", "the", "for", "with", "from"))
    rows = titled(spark, d).withColumn("words", words)
    shared = F.size(F.filter("words", lambda x: F.lower("t").contains(x)))
    title = F.when(F.col("from_url") == "", F.col("t")).when(F.col("generic"), F.col("from_url")).when(F.size("words") == 0, F.col("t")).when(shared < F.least(F.lit(2), F.size("words")), F.col("from_url")).otherwise(F.col("t"))
    return rows.select("page_id", title.alias("title"))


_kinds = "case page_id % 9 when 0 then 'FULL_TIME' when 1 then 'part time' when 2 then 'Contractor' when 3 then 'intern' when 4 then 'volunteer' when 5 then 'shift_work ' when 6 then 'temporary' when 7 then 'OTHER' else '' end"


@query("select page_id, case upper(regexp_replace(k, '[-\\s]+', '_', 'g')) " + " ".join(f"when '{k}' then '{v}'" for k, v in EMPLOYMENT) + f" else trim(replace(k, '_', ' ')) end as employment from (select page_id, {_kinds} as k from listings)", "listings")
def fn_employment_norm(spark, d):
    known = F.create_map(*[F.lit(x) for pair in EMPLOYMENT for x in pair])
    rows = listings(spark, d).select("page_id", F.expr(_kinds).alias("k"))
    return rows.select("page_id", F.coalesce(F.try_element_at(known, F.upper(F.regexp_replace("k", r"[-\s]+", "_"))), F.trim(F.replace("k", F.lit("_"), F.lit(" ")))).alias("employment"))


@query("select page_id, case when contains(lower(work_mode), 'remote') then 'Remote' when contains(lower(work_mode), 'hybrid') then 'Hybrid' when contains(lower(work_mode), 'site') then 'On-site' else '' end as mode, case when contains(lower(employment), 'full') then 'Full-time' when contains(lower(employment), 'part') then 'Part-time' else '' end as employment from listings", "listings")
def fn_employment_agg(spark, d):
    m, e = F.lower("work_mode"), F.lower("employment")
    return listings(spark, d).select("page_id", F.when(m.contains("remote"), "Remote").when(m.contains("hybrid"), "Hybrid").when(m.contains("site"), "On-site").otherwise("").alias("mode"), F.when(e.contains("full"), "Full-time").when(e.contains("part"), "Part-time").otherwise("").alias("employment"))


@query("select page_id, case when length(s_company) > 80 or regexp_matches(lower(s_company), '^(careers|jobs|apply|workday|login)$') then '' else trim(s_company) end as company from listings", "listings")
def fn_portal_company(spark, d):
    c = F.col("s_company")
    return listings(spark, d).select("page_id", F.when((F.length(c) > 80) | F.lower(c).rlike("^(careers|jobs|apply|workday|login)$"), "").otherwise(F.trim(c)).alias("company"))


@query("select doc_id, sha256(text) as input_hash, octet_length(encode(text)) as n_bytes, octet_length(encode(text)) > 4096 as cut from documents")
def fn_hash_input(spark, d):
    t = F.col("text")
    n = F.octet_length(t)
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("input_hash"), n.cast("long").alias("n_bytes"), (n > 4096).alias("cut"))


@query("select page_id, case when regexp_matches(title, '^[=+@\\t\\r-]') then '''' || title else title end as cell, '\"' || replace(case when regexp_matches(title, '^[=+@\\t\\r-]') then '''' || title else title end, '\"', '\"\"') || '\"' as csv from listings", "listings")
def prj_formula_guard(spark, d):
    t = F.col("title")
    cell = F.when(t.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), t)).otherwise(t)
    return listings(spark, d).select("page_id", cell.alias("cell"), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"')).alias("csv"))


@query("select page_id, '\"' || replace(s_company, '\"', '\"\"') || '\"' as csv from listings", "listings")
def prj_csv_cell(spark, d):
    return listings(spark, d).select("page_id", F.concat(F.lit('"'), F.replace("s_company", F.lit('"'), F.lit('""')), F.lit('"')).alias("csv"))


# Sinks as plans


def upserts(stored: DataFrame, batch: DataFrame, oldest_ms: int = 1704100000000) -> DataFrame:
    """The rows that an upsert by URL puts into a table of key, page_id, title, status: of a batch's rows of one URL the last one, none without a URL or older than `oldest_ms`; a known URL keeps its status, a new one is ready if it is complete, else queued."""
    best = first_by(batch.where("key is not null"), ["key"], F.desc("page_id")).where(F.col("created_ms") >= oldest_ms)
    complete = (F.col("title") != "") & (F.col("s_company") != "") & (F.length("description") >= 400) & (F.col("location") != "")
    known = stored.select("key", F.col("status").alias("held"))
    return best.withColumn("new", F.when(complete, "ready").otherwise("queued")).join(known, "key", "left").select("key", "page_id", "title", F.coalesce("held", "new").alias("status"))


def merged_into(path: str, rows: DataFrame, key: str, buckets: int = 8) -> None:
    """Put rows into a stored table in place of those with the same keys. Only the folders of the rows' buckets are written again; the same rows once more change nothing.

    The new folders are made from a copy of the old ones, as a folder cannot be read while it is overwritten.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = rows.withColumn("bucket", bucket)
    if stored_at(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select("bucket").distinct()
        kept = old.join(touched, "bucket", "left_semi").join(new.select(key), key, "left_anti").select(new.columns)
        whole = fresh_path(spark, "sink-merge")
        new.unionByName(kept).write.parquet(whole)
        new = spark.read.schema(new.schema).parquet(whole)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored_at(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@query(f"""with k as (select page_id, {normalized_sql('url')} as url, status, created_ms, title, s_company, description, location from listings),
old as (select url, min(page_id) as page_id from k where status = 'ready' and url is not null group by url),
b as (select *, row_number() over (partition by url order by page_id desc) as n from k where url is not null qualify n = 1),
u as (select b.url, b.page_id, case when b.url in (select url from old) then 'ready' when title <> '' and s_company <> '' and length(description) >= 400 and location <> '' then 'ready' else 'queued' end as status from b where created_ms >= 1704100000000)
select url as key, page_id, title, status from (select url, page_id, status from u union all select url, page_id, 'ready' from old where url not in (select url from u)) join (select page_id, title from listings) using (page_id)""", "listings")
def snk_upsert(spark, d):
    """The ready listings are stored, then all rows come in by an upsert, twice: what the table then holds."""
    k = listings(spark, d).withColumn("key", normalized(F.col("url")))
    path = fresh_path(spark, "sink-upsert")
    ready = first_by(k.where("status = 'ready' and key is not null"), ["key"], "page_id").select("key", "page_id", "title", "status")
    merged_into(path, ready, "key")
    for _ in range(2):
        stored = spark.read.schema(ready.schema).parquet(path)
        merged_into(path, upserts(stored, k), "key")
    return spark.read.schema(ready.schema).parquet(path).select("key", "page_id", "title", "status")


@query(f"with k as (select page_id, {normalized_sql('url')} as url, status from listings) select b.page_id, o.page_id as stored_id from k b left join (select url, min(page_id) as page_id from k where status = 'ready' group by url) o using (url)", "listings")
def jn_board_existing(spark, d):
    """Each row of a batch with the ready listing that has its URL, if there is one."""
    k = listings(spark, d).select("page_id", normalized(F.col("url")).alias("key"), "status")
    stored = k.where("status = 'ready'").groupBy("key").agg(F.min("page_id").alias("stored_id"))
    return k.join(stored, "key", "left").select("page_id", "stored_id")


@query("select page_id, coalesce(nullif(company, ''), nullif(s_company, ''), '') as company, coalesce(nullif(location, ''), nullif(s_location, ''), '') as location, case when sha256(description) = sha256(title) then 'same' else 'new' end as content from listings", "listings")
def snk_persist_result(spark, d):
    """Each listing's result, its blanks filled from the snapshot, with whether its content is new, stored by page and read back; a second write of the same results changes nothing."""
    pick = lambda c: F.coalesce(nz(F.col(c)), nz(F.col(f"s_{c}")), F.lit("")).alias(c)
    rows = listings(spark, d).select("page_id", pick("company"), pick("location"), F.when(F.sha2("description", 256) == F.sha2("title", 256), "same").otherwise("new").alias("content"))
    path = fresh_path(spark, "sink-results")
    for _ in range(2):
        merged_into(path, rows, "page_id")
    return spark.read.schema(rows.schema).parquet(path).select("page_id", "company", "location", "content")


@query("select page_id, case when status = 'partial' then title else trim(title) end as title, case when status = 'partial' then 'queued' else status end as status from listings where length(description) >= 60", "listings")
def snk_quality_cleanup(spark, d):
    """A cleaned copy of the listings: without those that have hardly a description, partial ones queued again, the others' titles trimmed. It is written whole before it stands for the old one."""
    partial = F.col("status") == "partial"
    rows = listings(spark, d).where(F.length("description") >= 60).select("page_id", F.when(partial, F.col("title")).otherwise(F.trim("title")).alias("title"), F.when(partial, "queued").otherwise(F.col("status")).alias("status"))
    path = fresh_path(spark, "sink-cleaned")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query(f"with {VIS} select page_id, title, coalesce(nullif(company, ''), s_company, '') as company, left(description, 6500) as preview, least(created_ms, {NOW_MS}) as shown_ms from vis where title <> ''", "listings")
def prj_job_card(spark, d):
    return visible(listings(spark, d)).where("title <> ''").select("page_id", "title", F.coalesce(nz(F.col("company")), "s_company", F.lit("")).alias("company"), F.substring("description", 1, 6500).alias("preview"), F.least("created_ms", F.lit(NOW_MS)).alias("shown_ms"))


@query("select method, count(*) as jobs, sum(page_id % 26)::bigint as credits from listings group by method", "listings")
def agg_credits_by_method(spark, d):
    return listings(spark, d).groupBy("method").agg(F.count("*").alias("jobs"), F.sum(F.col("page_id") % 26).alias("credits"))


@query("select strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') as day, sum(page_id % 26)::bigint as credits from listings group by 1", "listings")
def agg_credits_by_day(spark, d):
    return listings(spark, d).groupBy(created_day().cast("string").alias("day")).agg(F.sum(F.col("page_id") % 26).alias("credits"))


@query("with c as (select created_ms // 86400000 as day, sum(page_id % 26)::bigint as credits from listings group by 1), e as (select max(day) as last from c) select strftime(make_timestamp((last - 13 + i) * 86400000000), '%Y-%m-%d') as day, coalesce(credits, 0) as credits from e cross join range(14) t(i) left join c on c.day = last - 13 + i", "listings")
def dt_series_fill(spark, d):
    """Fourteen days without gaps."""
    rows = listings(spark, d)
    last = rows.agg(F.max(created_day())).scalar()
    days = spark.range(14).select(F.date_add(F.date_sub(last, 13), F.col("id").cast("int")).cast("string").alias("day"))
    return days.join(agg_credits_by_day(spark, d), "day", "left").na.fill(0, ["credits"])
