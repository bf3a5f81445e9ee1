"""Scores of links, fields told from texts, slugs, start pages and blocked addresses, each beside its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions import urls
from harvestry.functions.text import collapse, nz
from harvestry.operators.helpers import AGGREGATOR, POSTING
from harvestry.operators.records import HOUR, NOW_MS
from harvestry.plans.views import listings, robots, runs, table
from harvestry.registry import query

#: Paths that list postings, paths of one posting, and the scores of both.
LIST_PATHS = ("/jobs", "/job", "/careers", "/career", "/search")
ONE_POSTING = "/job/[^/]+|/jobs/[0-9]+|/jobs/listing/[^/]+|/jobs/[^/]{6,}"
#: Hosts that are never fetched through the paid proxy.
NEVER = ("media.licdn.com", "instagram.com", "twitter.com", "x.com", "facebook.com", "developers.cloudflare.com", "linkedin.com", "indeed.com")
#: IPv4 ranges that no outbound call may reach.
BLOCKED = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()
#: Country codes that a location may end with.
COUNTRIES = {"IN": "India", "US": "United States", "GB": "United Kingdom", "CA": "Canada", "AU": "Australia"}
_PATH = "^https?://[^/?#]+([^?#]*)"


def href_score(url: Column) -> Column:
    """How much an absolute link looks like one posting; -999 for blank text, fragments and other schemes."""
    raw = F.coalesce(nz(F.regexp_extract(url, _PATH, 1)), F.lit("/"))
    p = F.coalesce(nz(F.regexp_replace(F.lower(raw), "/+$", "")), F.lit("/"))
    lists = p.isin(*LIST_PATHS) | (p.endswith("/jobs") & ~p.rlike("/jobs/.+"))
    softer = F.when(p.rlike("job-?detail"), 75).otherwise(0) + F.when(p.contains("/career"), 38).otherwise(0)
    score = F.lit(12.0) + F.least(F.length(raw), F.lit(120)) / 40 - F.when(lists, 120).otherwise(0) + F.when(p.rlike(ONE_POSTING), 220).otherwise(softer)
    score = score + F.when(F.lower(url).contains("amazon.jobs") & (F.length(p) > 15), 15).otherwise(0)
    return F.when(url.rlike("(?i)^https?://[^/?#]+"), score).otherwise(F.lit(-999.0))


def _score_sql(rows: str) -> str:
    """SQL for the columns of `rows`, which has u, with their score."""
    return f"""(select *, case when not regexp_matches(u, '(?i)^https?://[^/?#]+') then -999.0 else 12.0 + least(length(raw), 120) / 40.0
        - case when p in {LIST_PATHS} or (p like '%/jobs' and not regexp_matches(p, '/jobs/.+')) then 120 else 0 end
        + case when regexp_matches(p, '{ONE_POSTING}') then 220 else case when regexp_matches(p, 'job-?detail') then 75 else 0 end + case when contains(p, '/career') then 38 else 0 end end
        + case when contains(lower(u), 'amazon.jobs') and length(p) > 15 then 15 else 0 end end::double as score
        from (select *, case when regexp_replace(lower(raw), '/+$', '') = '' then '/' else regexp_replace(lower(raw), '/+$', '') end as p
              from (select *, case when regexp_extract(u, '{_PATH}', 1) = '' then '/' else regexp_extract(u, '{_PATH}', 1) end as raw from {rows})))"""


_hrefs = "case page_id % 8 when 1 then 'https://a.com/jobs/' when 2 then 'https://a.com/job/' || page_id || '-writer' when 3 then 'https://www.amazon.jobs/en/jobs/' || page_id || '/sde' when 4 then 'https://a.com/careers/jobdetail?id=1' when 5 then 'javascript:void(0)' when 6 then '#top' when 7 then 'https://b.org/team/jobs' else url end"


@query(f"select page_id, score from {_score_sql(f'(select page_id, {_hrefs} as u from listings)')}", "listings")
def fn_href_score(spark, d):
    return listings(spark, d).select("page_id", href_score(F.expr(_hrefs)).alias("score"))


_card = "['#top', 'https://' || host || '/jobs', url, case when page_id % 2 = 0 then 'https://' || host || '/job/' || page_id else '' end]"


@query(f"select page_id, arg_max(u, score * 1000 - i) filter (where score > -900) as href from {_score_sql(f'(select page_id, unnest({_card}) as u, generate_subscripts({_card}, 1) as i from listings)')} group by page_id", "listings")
def fn_href_best(spark, d):
    """The link of a card with the best score, the first of equal ones; null where none is a link."""
    own = lambda *c: F.concat(F.lit("https://"), "host", *c)
    card = F.array(F.lit("#top"), own(F.lit("/jobs")), F.col("url"), F.when(F.col("page_id") % 2 == 0, own(F.lit("/job/"), F.col("page_id").cast("string"))).otherwise(""))
    ranked = F.transform(card, lambda x, i: F.struct(href_score(x).alias("score"), (-i).alias("place"), x.alias("href")))
    return listings(spark, d).select("page_id", F.array_max(F.filter(ranked, lambda x: x.score > -900)).href.alias("href"))


_S = "[ \\t\\n\\r\\f]"
_YEARS = f"(?i)([0-9]+)[+]?{_S}*(?:[+]|plus{_S}+)?years?{_S}+of{_S}+experience"
_word = lambda w: f"(?i)(^|[^a-zA-Z0-9_]){w}([^a-zA-Z0-9_]|$)"
#: Words that tell the kind of employment and the place of work, in order of precedence.
KINDS = (("Internship", _word("intern(ship)?")), ("Part-time", _word(f"part(-|{_S})?time")), ("Contract", _word("contract(or)?")), ("Full-time", _word(f"full(-|{_S})?time")))
PLACES = (("Remote", _word("remote")), ("Hybrid", _word("hybrid")), ("Onsite", "(?i)(^|[^a-zA-Z0-9_])onsite|on-site|in-office([^a-zA-Z0-9_]|$)"))
_told = "case doc_id % 6 when 0 then '5+ years of experience, part-time, remote. ' when 1 then '40 years of experience; 3 plus years of experience. Contractor, on-site. ' when 2 then 'Internship, hybrid. ' when 3 then 'Full time. ' else '' end || coalesce(text, '')"
_cases = lambda c, rules: "case " + " ".join(f"when regexp_matches({c}, '{r}') then '{v}'" for v, r in rules) + " else '' end"


@query(f"select doc_id, coalesce(list_max(list_filter(list_transform(regexp_extract_all(head, '{_YEARS}', 1), lambda x: try_cast(x as integer)), lambda x: x between 1 and 30)), 0) as years, {_cases('head', KINDS)} as employment, {_cases('left(head, 800)', PLACES)} as place from (select doc_id, left({_told}, 3500) as head from documents)")
def fn_derive_fields(spark, d):
    """Years of experience, 30 at most (0: none told), and kind of employment in a text's first 3500 signs, place of work in its first 800: the rule's own spans."""
    told = lambda c, rules: F.coalesce(*[F.when(c.rlike(r), v) for v, r in rules], F.lit(""))
    x = table(spark, d, "documents").select("doc_id", F.substring(F.expr(_told), 1, 3500).alias("head"))
    years = F.transform(F.regexp_extract_all("head", F.lit(_YEARS), F.lit(1)), lambda n: n.try_cast("int"))
    most = F.coalesce(F.array_max(F.filter(years, lambda n: n.between(1, 30))), F.lit(0))
    return x.select("doc_id", most.alias("years"), told(F.col("head"), KINDS).alias("employment"), told(F.substring("head", 1, 800), PLACES).alias("place"))


_city = "case page_id % 7 when 0 then coalesce(s_location, '') || ', IN' when 1 then 'Austin,US' when 2 then 'Leeds,   gb' when 3 then 'Toronto, Ontario, CA' when 4 then 'Perth,  AU' end"
_full = "case when page_id % 7 = 5 then '  Remote   -  ' || coalesce(s_location, '') end"
_cities = reduce(lambda c, k: f"regexp_replace({c}, '(?i),\\s*{k}$', ', {COUNTRIES[k]}')", COUNTRIES, "city")


@query(f"select page_id, trim(regexp_replace(coalesce(formatted, {_cities}, concat_ws(', ', nullif(trim(s_category), ''), nullif(trim(s_company), ''))), '\\s+', ' ', 'g')) as place from (select *, {_city} as city, {_full} as formatted from listings)", "listings")
def fn_location_agg(spark, d):
    """The display form, else the first city with its country spelt out, else state and country."""
    city = reduce(lambda c, k: F.regexp_replace(c, rf"(?i),\s*{k}$", f", {COUNTRIES[k]}"), COUNTRIES, F.expr(_city))
    return listings(spark, d).select("page_id", collapse(F.coalesce(F.expr(_full), city, F.concat_ws(", ", nz(F.col("s_category")), nz(F.col("s_company"))))).alias("place"))


_slugs = "case page_id % 4 when 0 then 'https://hiring.cafe/job/senior-data-engineer-austin-tx-' || substr(md5(cast(page_id as {t})), 1, 10) when 1 then 'https://hiring.cafe/job/qa--lead/' when 2 then url else 'not a url' end"


@query(f"""select page_id, list_aggregate(list_transform(case when regexp_matches(parts[len(parts)], '(?i)^[a-z0-9]{{8,}}$') then parts[1:len(parts) - 1] else parts end, lambda w: upper(w[1]) || substr(w, 2)), 'string_agg', ' ') as title
    from (select page_id, list_filter(string_split(regexp_extract(regexp_extract({_slugs.format(t='varchar')}, '{_PATH}', 1), '([^/]+)/*$', 1), '-'), lambda w: w <> '') as parts from listings)""", "listings")  # fmt: skip
def hp_agg_title_slug(spark, d):
    """A title from the words of a URL's last segment without the id behind them; null where nothing is left."""
    slug = F.regexp_extract(F.regexp_extract(F.expr(_slugs.format(t="string")), _PATH, 1), "([^/]+)/*$", 1)
    x = listings(spark, d).select("page_id", F.filter(F.split(slug, "-"), lambda w: w != "").alias("parts"))
    coded = F.try_element_at("parts", F.lit(-1)).rlike("(?i)^[a-z0-9]{8,}$")
    words = F.filter("parts", lambda w, i: ~F.coalesce(coded, F.lit(False)) | (i < F.size("parts") - 1))
    named = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return x.select("page_id", nz(F.array_join(named, " ")).alias("title"))


_found = "[url, case when page_id % 2 = 0 then 'https://hiring.cafe/job/' || page_id else '' end, case when page_id % 3 = 0 then ' https://www.hiring.cafe/job/longer-' || page_id || ' ' else '' end, 'hiring.cafe/job/x', 'https://hiring.cafe/?q=1']"


@query(f"select page_id, arg_max(u, length(u) * 10 - i) filter (where regexp_matches(u, '{AGGREGATOR}') and regexp_matches(u, '{POSTING}')) as url from (select page_id, trim(unnest({_found})) as u, generate_subscripts({_found}, 1) as i from listings) group by page_id", "listings")
def hp_agg_pick_url(spark, d):
    """The longest of a row's texts that is an aggregator's posting, the first of equal ones; null without any."""
    texts = F.transform(F.expr(_found.replace("[", "array(", 1)[:-1] + ")"), lambda x: F.trim(x))
    ranked = F.transform(texts, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("place"), x.alias("url")))
    return listings(spark, d).select("page_id", F.array_max(F.filter(ranked, lambda x: x.url.rlike(AGGREGATOR) & x.url.rlike(POSTING))).url.alias("url"))


_sites = "case page_id % 5 when 0 then 'Careers.' || host when 1 then 'www.ey.com' when 2 then 'jobs.ibm.com' when 3 then '' else host end"


@query(f"""select page_id, case when length(b) <= 3 then upper(b) else upper(b[1]) || substr(b, 2) end as company from (select page_id, case when len(p) >= 3 and p[1] in ('careers', 'jobs') then p[2] else coalesce(p[1], 'successfactors') end as b
    from (select page_id, list_filter(string_split(regexp_replace(lower({_sites}), '^www[.]', ''), '.'), lambda x: x <> '') as p from listings))""", "listings")  # fmt: skip
def hp_company_sf(spark, d):
    """A brand from a careers host; one of three letters at most is set in capitals."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.expr(_sites)), "^www[.]", ""), "[.]"), lambda x: x != "")
    x = listings(spark, d).select("page_id", parts.alias("p"))
    brand = F.when((F.size("p") >= 3) & F.try_element_at("p", F.lit(1)).isin("careers", "jobs"), F.try_element_at("p", F.lit(2))).otherwise(F.coalesce(F.try_element_at("p", F.lit(1)), F.lit("successfactors")))
    x = x.select("page_id", brand.alias("b"))
    return x.select("page_id", F.when(F.length("b") <= 3, F.upper("b")).otherwise(F.concat(F.upper(F.substring("b", 1, 1)), F.expr("substring(b, 2)"))).alias("company"))


_starts = "case page_id % 4 when 0 then 'https://c.com/go/x?q=a&startrow=25&loc=b&startrow=' || page_id || '#f' when 1 then 'https://c.com/search/?q=a' when 2 then url else 'not a url' end"


@query(f"""select page_id, case when base = '' then u else base || case when regexp_matches(base, '^https?://[^/]+$') then '/' else '' end || '?' || array_to_string(case when spot > 0 then list_transform(list_filter(q, lambda x, i: string_split(x, '=')[1] <> 'startrow' or i = spot), lambda x: case when string_split(x, '=')[1] = 'startrow' then 'startrow=0' else x end) else list_append(q, 'startrow=0') end, '&') || frag end as url
    from (select *, coalesce(list_position(list_transform(q, lambda x: string_split(x, '=')[1]), 'startrow'), 0) as spot from (select page_id, u, regexp_extract(u, '^https?://[^?#]+') as base, regexp_extract(u, '#.*$') as frag, list_filter(string_split(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '') as q from (select page_id, {_starts} as u from listings)))""", "listings")  # fmt: skip
def hp_url_sf_start(spark, d):
    """The first page of a list: startrow is set to 0 where it first stands, or appended; other pairs stay as they are, text that is no URL too."""
    x = listings(spark, d).select("page_id", F.expr(_starts).alias("u"))
    key = lambda p: F.element_at(F.split(p, "="), 1)
    pairs = F.filter(F.split(F.regexp_extract("u", r"^[^?#]*[?]([^#]*)", 1), "&"), lambda p: p != "")
    x = x.select("page_id", "u", F.regexp_extract("u", "^https?://[^?#]+", 0).alias("base"), F.regexp_extract("u", "#.*$", 0).alias("frag"), pairs.alias("q"))
    x = x.withColumn("at", F.array_position(F.transform("q", key), "startrow"))
    reset = F.transform(F.filter("q", lambda p, i: (key(p) != "startrow") | (i + 1 == F.col("at"))), lambda p: F.when(key(p) == "startrow", "startrow=0").otherwise(p))
    q = F.array_join(F.when(F.col("at") > 0, reset).otherwise(F.array_append("q", F.lit("startrow=0"))), "&")
    root = F.when(F.col("base").rlike("^https?://[^/]+$"), "/").otherwise("")
    return x.select("page_id", F.when(F.col("base") == "", F.col("u")).otherwise(F.concat("base", root, F.lit("?"), q, "frag")).alias("url"))


_asked = "case page_id % 5 when 0 then 'https://www.LinkedIn.com/jobs/1' when 1 then 'https://m.facebook.com/x' when 2 then 'https://x.com' when 3 then '' else url end"


@query(f"select page_id, regexp_replace(regexp_extract(lower({_asked}), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www[.]', '') in {NEVER} as never from listings", "listings")
def hp_never_scrape(spark, d):
    """Whether a URL's host is one that the paid proxy never fetches; false for what is no URL."""
    return listings(spark, d).select("page_id", F.coalesce(urls.host(F.expr(_asked)).isin(*NEVER), F.lit(False)).alias("never"))


_ips = "case run_id % 8 when 0 then '10.' || (run_id % 256) || '.0.1' when 1 then '172.' || (run_id % 32 + 8) || '.5.5' when 2 then '8.8.' || (run_id % 256) || '.8' when 3 then '100.' || (run_id % 256) || '.1.1' when 4 then '192.168.0.' || (run_id % 300) when 5 then '198.' || (run_id % 40) || '.0.9' when 6 then '224.0.0.1' else 'example.com' end"


def _network(cidr: str) -> tuple[int, int]:
    """A range as its first address and the number of addresses in it."""
    base, bits = cidr.split("/")
    return sum(int(o) << s for o, s in zip(base.split("."), (24, 16, 8, 0))), 1 << 32 - int(bits)


@query("select run_id, ip, coalesce(" + " or ".join(f"v between {a} and {a + n - 1}" for a, n in map(_network, BLOCKED)) + f""", false) as unsafe from (select run_id, ip, case when len(o) = 4 and list_max(o) <= 255 then ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] end as v
    from (select run_id, ip, case when regexp_matches(ip, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') then list_transform(string_split(ip, '.'), lambda x: cast(x as bigint)) end as o from (select run_id, {_ips} as ip from runs)))""", "runs")  # fmt: skip
def flt_cidr(spark, d):
    """Whether an address lies in a blocked IPv4 range, by its leading bits; what is no IPv4 address does not."""
    x = runs(spark, d).select("run_id", F.expr(_ips).alias("ip"))
    octets = F.transform(F.split("ip", "[.]"), lambda o: o.try_cast("long"))
    valid = F.col("ip").rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$") & (F.array_max("o") <= 255)
    x = x.withColumn("o", octets).withColumn("v", F.when(valid, F.aggregate("o", F.lit(0).cast("long"), lambda a, o: a * 256 + o)))
    hit = reduce(lambda a, b: a | b, [F.floor(F.col("v") / n) == a // n for a, n in map(_network, BLOCKED)])
    return x.select("run_id", "ip", F.coalesce(hit, F.lit(False)).alias("unsafe"))


@query(f"select robot_id, {NOW_MS} + 60000 + cast(floor(cast('0x' || substr(md5(cast(robot_id as varchar)), 1, 8) as bigint) / 4294967296.0 * ((robot_id % 6 + 1) * 3600000 - 60000)) as bigint) as start_ms from robots", "robots")
def hp_first_start(spark, d):
    """A first start within a robot's interval, a minute from now at least; the draw is a hash of the robot, so that reruns agree."""
    share = F.conv(F.substring(F.md5(F.col("robot_id").cast("string")), 1, 8), 16, 10).cast("long") / 4294967296.0
    return robots(spark, d).select("robot_id", (F.lit(NOW_MS + 60000) + F.floor(share * ((F.col("robot_id") % 6 + 1) * HOUR - 60000))).alias("start_ms"))
