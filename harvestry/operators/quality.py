"""What a parsed posting is good for: one brand for a company's names, fields merged from two parses, rows fit for the board, parses too thin to keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions.text import decode_entities, entities_sql
from harvestry.operators.canonical import DETAIL_HOST, DETAIL_PATH
from harvestry.operators.helpers import pick, pick_sql
from harvestry.operators.listings import GENERIC, JUNKED, STRONG, TITLED, described, titled
from harvestry.plans.views import listings, table
from harvestry.registry import query
from harvestry.sources.pages import LDJ, SHAPED, _mtitle, head_meta, structured

#: Names under which an employer appears, in lower case with single spaces for points, lines and spaces.
BRANDS = {
    "JPMorgan Chase": ("jpmc", "jp morgan", "j p morgan", "jpmorgan", "jpmorgan chase", "jp morgan chase"),
    "Meta": ("metacareers", "meta careers", "facebook"), "Stripe": ("stripe",), "IBM": ("ibm", "ibm corporation", "international business machines"), "Sia Partners": ("sia partners", "siapartners"),
    "Carrier": ("carrier", "carrierjobs", "carrier jobs", "carrier home", "carrier (home)", "carrier corporate", "c01 carrier corporation", "carrier corporation", "carrier global", "carrier global corporation"),
    "Ford": ("ford", "ford motor", "ford motor company"), "Toyota": ("toyota", "toyota motor", "toyota motor corporation", "toyota motor north america", "tmna"),
}
NAMES = {name: brand for brand, names in BRANDS.items() for name in names}
#: Bytes under which a page is no posting, and characters under which a description must say what postings say.
LEAST_BYTES, TEASER = 1500, 400


def brand(name: Column) -> Column:
    """One name for all that an employer is called; other names only trimmed and decoded."""
    text = decode_entities(F.coalesce(name, F.lit("")))
    key = F.trim(F.regexp_replace(F.lower(text), r"[.\s_-]+", " "))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), key), text)


CALLED = ("J.P. Morgan", "JPMORGAN_CHASE", "Meta-Careers", "ibm", "Sia-Partners", "C01 Carrier Corporation", "Carrier (Home)", "tmna", "Ford Motor Co", "A &amp; B", None, None, None)
_called = f"coalesce({pick_sql('page_id', *CALLED)}, s_company)"
_brand = "case " + " ".join(f"when regexp_matches(k, '^({'|'.join(n.replace('(', '[(]').replace(')', '[)]') for n in names)})$') then '{b}'" for b, names in BRANDS.items()) + " else t end"


@query(f"select page_id, {_brand} as company from (select *, trim(regexp_replace(lower(t), '[.\\s_-]+', ' ', 'g')) as k from (select page_id, {entities_sql(f'coalesce({_called}, chr(32))')} as t from listings))", "listings")
def fn_canon_company(spark, d):
    return listings(spark, d).select("page_id", brand(F.coalesce(pick(F.col("page_id"), *CALLED), F.col("s_company"))).alias("company"))


def generic(title: Column) -> Column:
    return (F.length(title) < 3) | title.rlike(GENERIC)


def merged_title(a: Column, b: Column) -> Column:
    """The first title that names a posting, else the first that is not blank."""
    a, b = decode_entities(F.coalesce(a, F.lit(""))), decode_entities(F.coalesce(b, F.lit("")))
    return F.when((a != "") & ~generic(a), a).when((b != "") & ~generic(b), b).otherwise(F.coalesce(F.nullif(a, F.lit("")), b))


_g = lambda c: f"(length({c}) < 3 or regexp_matches({c}, '{GENERIC}'))"


@query(f"""with {SHAPED}, {LDJ}, m as (select page_id, case when page_id % 4 = 1 then 'Careers' else {entities_sql("coalesce(title, '')")} end as a, {entities_sql(f'({_mtitle})')} as b, coalesce(company, '') as company, title is not null as first from j)
select page_id, case when a <> '' and not {_g('a')} then a when b <> '' and not {_g('b')} then b else coalesce(nullif(a, ''), b) end as title, company, case when first then 'jsonld' when b <> '' then 'meta' else 'none' end as source from m""", "listings")
def fn_merge_fields(spark, d):
    """The structured data of a page over its meta tags, field by field; a title that names nothing gives way."""
    x = head_meta(structured(spark, d))
    a = F.when(F.col("page_id") % 4 == 1, "Careers").otherwise(F.col("title"))
    source = F.when(F.col("title").isNotNull(), "jsonld").when(decode_entities(F.col("m_title")) != "", "meta").otherwise("none")
    return x.select("page_id", merged_title(a, F.col("m_title")).alias("title"), decode_entities(F.coalesce("company", F.lit(""))).alias("company"), source.alias("source"))


_detail = f"not (regexp_matches(regexp_extract(posting, '^https?://([^/?#:]+)', 1), '{DETAIL_HOST}') and not regexp_matches(regexp_extract(posting, '^https?://[^/?#]+([^?#]*)', 1), '{DETAIL_PATH}'))"


@query(f"with {TITLED}, {JUNKED}, x as (select page_id, posting, case when t <> '' and not generic then t else coalesce(nullif(from_url, ''), t) end as title from titled) select page_id, {_detail} and title <> '' and not {_g('title')} and coalesce(t <> '' and not junk, false) as passes from x left join scored on doc_id = page_id", "listings")
def flt_board_quality(spark, d):
    """Rows that the board may show: no hub of a career site, a title that names a posting, if only in its URL, and a description that is one."""
    host, path = F.regexp_extract("posting", r"^https?://([^/?#:]+)", 1), F.regexp_extract("posting", r"^https?://[^/?#]+([^?#]*)", 1)
    title = F.when((F.col("t") != "") & ~F.col("generic"), F.col("t")).otherwise(F.coalesce(F.nullif("from_url", F.lit("")), "t"))
    rows = titled(spark, d).withColumn("title", title).withColumn("hub", host.rlike(DETAIL_HOST) & ~path.rlike(DETAIL_PATH))
    texts = described(spark, d).select(F.col("doc_id").alias("page_id"), F.col("t").alias("text"), "junk")
    fine = F.coalesce((F.col("text") != "") & ~F.col("junk"), F.lit(False))
    return rows.join(texts, "page_id", "left").select("page_id", (~F.col("hub") & (F.col("title") != "") & ~generic(F.col("title")) & fine).alias("passes"))


def thin(title: Column, description: Column, score: Column, source: Column, n_bytes: Column) -> Column:
    """Whether a parse calls for a dearer fetch: a small page, no title or description, a description that scores nothing, a title that names nothing, or a short text without what postings say."""
    teaser = (F.length(description) < TEASER) & ~description.rlike(STRONG)
    bare = (description == "") | (score == 0) | ((title != "") & generic(title)) | teaser
    return (n_bytes < LEAST_BYTES) | bare | ((source == "meta") & teaser)


@query(f"with {TITLED}, {JUNKED}, x as (select p.page_id, strlen(p.html) as n, coalesce(s.t, '') as d, coalesce(score, 0) as score, i.t as title from pages p join titled i on i.page_id = p.page_id left join scored s on s.doc_id = p.page_id) select page_id, n < {LEAST_BYTES} or d = '' or score = 0 or (title <> '' and {_g('title')}) or (length(d) < {TEASER} and not regexp_matches(d, '{STRONG}')) as thin from x", "listings")
def flt_thin_parse(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.octet_length("html").alias("n"))
    texts = described(spark, d).select(F.col("doc_id").alias("page_id"), F.col("t").alias("d"), "score")
    x = pages.join(titled(spark, d).select("page_id", F.col("t").alias("title")), "page_id").join(texts, "page_id", "left")
    return x.select("page_id", thin(F.col("title"), F.coalesce("d", F.lit("")), F.coalesce("score", F.lit(0.0)), F.lit("html"), F.col("n")).alias("thin"))
