"""Pages to rows: structured data, meta tags, text, tables, lists and links, and the crawl over a link graph.

What stands in a page in a fixed form is taken with native expressions; selectors and tables go by the table
of elements (`dom`). Pages get a head with structured data and a table from the listing
table, so that the SQL twins can say from there what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions.text import decode_entities, entities_sql, nz
from harvestry.plans.views import listings, table
from harvestry.registry import query
from harvestry.sources.dom import detect_tables, scrape_ranked

#: Blocks of structured data read from a page at most.
MOST_BLOCKS = 20
LD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
POSTING = "`@type` string, title string, datePosted string, employmentType string, url string, hiringOrganization struct<name: string>"


def rich(spark, d) -> DataFrame:
    """page_id, url, html: pages with structured data in one of five forms, meta tags in either attribute order, and a table."""
    rows = table(spark, d, "pages").join(listings(spark, d).select("page_id", "title", "s_company", "employment", "created_ms"), "page_id")
    pid, t = F.col("page_id"), F.substring(F.regexp_replace("title", r"[\"\\\\<>&']", " "), 1, 60)
    post = F.to_json(F.struct(F.when(pid % 2 == 0, F.lit("JobPosting")).otherwise("jobposting-like").alias("@type"), t.alias("title"), F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd").alias("datePosted"), "employment", F.struct(F.col("s_company").alias("name")).alias("hiringOrganization")))
    post = F.replace(post, F.lit('"employment"'), F.lit('"employmentType"'))
    other = F.lit('{"@type":"Organization","title":"not a posting"}')
    data = F.when(pid % 5 == 0, post).when(pid % 5 == 1, F.concat(F.lit("["), other, F.lit(","), post, F.lit("]"))).when(pid % 5 == 2, F.concat(F.lit('{"@graph":['), other, F.lit(","), post, F.lit(","), post, F.lit("]}"))).when(pid % 5 == 3, F.concat(F.lit('{"itemListElement":[{"item":'), post, F.lit("},"), post, F.lit("]}"))).otherwise("{broken")
    script = F.concat(F.lit("<script data-x='1' type=\"application/ld+json\">"), data, F.lit("</script>"))
    meta = F.when(pid % 3 == 0, F.concat(F.lit('<meta property="og:title" content="'), t, F.lit(' &amp; more"><meta name="description" content="About it">'))).when(pid % 3 == 1, F.concat(F.lit("<meta content='"), t, F.lit("' name='twitter:title'><link href=\"/i.png\" rel=\"icon\">"))).otherwise("")
    cells = F.concat(F.lit("<table><tr><th>Name</th><th> </th></tr><tr><td>"), t, F.lit("</td><td>"), pid.cast("string"), F.lit("</td></tr></table><table><tr><td>alone</td></tr></table>"))
    html = F.replace(F.replace("html", F.lit("</head>"), F.concat(script, meta, F.lit("</head>"))), F.lit("</article>"), F.concat(cells, F.lit("</article>")))
    return rows.select("page_id", "url", html.alias("html"))


T = "left(regexp_replace(title, '[\"\\\\<>&'']', ' ', 'g'), 60)"
SHAPED = f"x as (select page_id, url, {T} as t, s_company, employment, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') as day from listings)"


def blocks(html) -> F.Column:
    return F.slice(F.filter(F.transform(F.regexp_extract_all(html, F.lit(LD), F.lit(1)), lambda b: F.trim(b)), lambda b: b != ""), 1, MOST_BLOCKS)


def postings(html) -> F.Column:
    """The postings of all blocks: alone, in lists, in graphs and as list items. Blocks that are no JSON are passed over."""
    each = F.flatten(F.transform(blocks(html), lambda b: F.coalesce(F.from_json(F.when(b.startswith("["), b).otherwise(F.concat(F.lit("["), b, F.lit("]"))), "array<string>"), F.array().cast("array<string>"))))
    inner = lambda b: F.concat(F.array(b), *[F.coalesce(F.from_json(F.get_json_object(b, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("@graph", "itemListElement")])
    nodes = F.transform(F.flatten(F.transform(each, inner)), lambda b: F.coalesce(F.get_json_object(b, "$.item"), b))
    return F.filter(F.transform(nodes, lambda b: F.from_json(b, POSTING)), lambda p: F.coalesce(p["@type"].rlike('^JobPosting$|"JobPosting"'), F.lit(False)))


@query("select page_id, case when page_id % 5 = 4 then 7 end as broken_length, 1 as n_blocks from listings", "listings")
def html_jsonld_blocks(spark, d):
    x = rich(spark, d).select("page_id", blocks(F.col("html")).alias("b"))
    return x.select("page_id", F.when(F.get("b", F.lit(0)) == "{broken", F.length(F.get("b", F.lit(0)))).alias("broken_length"), F.size("b").alias("n_blocks"))


_n = "case when page_id % 2 = 1 or page_id % 5 = 4 then 0 when page_id % 5 in (2, 3) then 2 else 1 end"


@query(f"with {SHAPED} select page_id, {_n} as n_postings from x", "listings")
def html_jsonld_postings(spark, d):
    return rich(spark, d).select("page_id", F.size(postings(F.col("html"))).alias("n_postings"))


def structured(spark, d) -> DataFrame:
    """page_id, url, html and the first posting's fields, null where there is none."""
    p = F.get(postings(F.col("html")), F.lit(0))
    rows = rich(spark, d).select("page_id", "url", "html", p.alias("p"))
    kinds = F.create_map(*[F.lit(v) for pair in (("full_time", "Full-time"), ("part_time", "Part-time"), ("contract", "contract")) for v in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_replace("p.employmentType", "[- ]", "_"))), F.col("p.employmentType"))
    return rows.select("page_id", "url", "html", F.trim("p.title").alias("title"), F.coalesce(F.trim("p.hiringOrganization.name"), F.when(F.col("p").isNotNull(), "")).alias("company"), kind.alias("employment"), F.col("p.datePosted").alias("date"))


_employment = "case lower(replace(replace(employment, '-', '_'), ' ', '_')) when 'full_time' then 'Full-time' when 'part_time' then 'Part-time' when 'contract' then 'contract' else employment end"
LDJ = f"j as (select page_id, url, t, case when {_n} > 0 then trim(t) end as title, case when {_n} > 0 then trim(coalesce(s_company, '')) end as company, case when {_n} > 0 then {_employment} end as employment, case when {_n} > 0 then day end as date from x)"


@query(f"with {SHAPED}, {LDJ} select page_id, title, company, employment, date from j where title is not null", "listings")
def html_jsonld_parse(spark, d):
    return structured(spark, d).where("title is not null").select("page_id", "title", "company", "employment", "date")


@query(f"with {SHAPED}, {LDJ} select page_id, title, company from j where title is not null", "listings")
def html_ext_schema(spark, d):
    """The form that a browser plug-in reads: fewer fields of the same posting."""
    return structured(spark, d).where("title is not null").select("page_id", "title", "company")


def meta(head, name: str) -> F.Column:
    """The content of a meta tag, whichever attribute stands first."""
    a = F.regexp_extract(head, rf"(?i)<meta[^>]*(?:property|name)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"'][^>]*>", 1)
    b = F.regexp_extract(head, rf"(?i)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:property|name)=[\"']{name}[\"'][^>]*>", 1)
    return F.coalesce(nz(a), nz(b), F.lit(""))


def head_meta(rows: DataFrame) -> DataFrame:
    """rows with html -> with m_title, m_description, m_icon; only the head is searched."""
    rows = rows.withColumn("head", F.substring_index("html", "</head>", 1))
    title = decode_entities(F.coalesce(nz(meta(F.col("head"), "og:title")), meta(F.col("head"), "twitter:title")))
    icon = F.coalesce(nz(F.regexp_extract("head", r"(?i)<link[^>]*rel=[\"'](?:apple-touch-icon|icon|shortcut icon)[\"'][^>]*href=[\"']([^\"']+)[\"']", 1)), F.regexp_extract("head", r"(?i)<link[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"'](?:apple-touch-icon|icon|shortcut icon)[\"']", 1))
    return rows.withColumn("m_title", title).withColumn("m_description", decode_entities(meta(F.col("head"), "description"))).withColumn("m_icon", icon).drop("head")


_mtitle = f"case page_id % 3 when 0 then {entities_sql('t')} || ' & more' when 1 then {entities_sql('t')} else '' end"


@query(f"with {SHAPED} select page_id, trim({_mtitle}) as title, case when page_id % 3 = 0 then 'About it' else '' end as description, case when page_id % 3 = 1 then '/i.png' else '' end as icon from x where page_id % 3 <> 2", "listings")
def html_meta(spark, d):
    x = head_meta(rich(spark, d)).where("m_title <> '' or m_description <> ''")
    return x.select("page_id", F.col("m_title").alias("title"), F.col("m_description").alias("description"), F.col("m_icon").alias("icon"))


@query(f"with {SHAPED}, {LDJ}, h as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')) as h1 from pages) select page_id, coalesce(nullif(title, ''), nullif(trim({_mtitle}), ''), {entities_sql('h1')}) as title, coalesce(company, '') as company, case when nullif(title, '') is not null then 'jsonld' when page_id % 3 <> 2 then 'meta' else 'html' end as source from j join h using (page_id)", "listings")
def html_parse_page(spark, d):
    """Structured data, else meta tags, else the page's heading."""
    x = head_meta(structured(spark, d))
    heading = decode_entities(F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")))
    source = F.when(nz(F.col("title")).isNotNull(), "jsonld").when(F.col("m_title") != "", "meta").otherwise("html")
    return x.select("page_id", F.coalesce(nz(F.col("title")), nz(F.col("m_title")), heading).alias("title"), F.coalesce("company", F.lit("")).alias("company"), source.alias("source"))


# Text


#: Elements whose text is not the page's own.
CHROME = "script|style|nav|header|footer|aside|noscript|svg|form"
_plain = "html"
for _tag in CHROME.split("|"):
    _plain = f"regexp_replace({_plain}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_plain = f"regexp_replace({_plain}, '(?is)<!--.*?-->|<title[^>]*>.*?</title>', ' ', 'g')"
_plain = f"regexp_replace(regexp_replace({_plain}, '(?i)<li[^>]*>', chr(10) || '• ', 'g'), '(?i)<br ?/?>|</(p|div|h[1-6]|li|ul|ol|tr|article)>', chr(10), 'g')"
_plain = f"regexp_replace({_plain}, '<[^>]+>', ' ', 'g')"


def own_text(html) -> F.Column:
    """A page's own text: without scripts, navigation and the like, line feeds at block ends, bullets at items."""
    for tag in CHROME.split("|"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    html = F.regexp_replace(html, r"(?is)<!--.*?-->|<title[^>]*>.*?</title>", " ")
    html = F.regexp_replace(F.regexp_replace(html, "(?i)<li[^>]*>", "\n• "), "(?i)<br ?/?>|</(p|div|h[1-6]|li|ul|ol|tr|article)>", "\n")
    return F.regexp_replace(html, "<[^>]+>", " ")


@query(f"select page_id, {entities_sql(_plain)} as text from pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", decode_entities(own_text(F.col("html"))).alias("text"))


#: Characters of a plain text at most; the cut shows.
MOST_TEXT = 2000


@query(f"select page_id, case when length(t) > {MOST_TEXT} then rtrim(left(t, {MOST_TEXT})) || '…' else t end as text from (select page_id, {entities_sql(_plain)} as t from pages)")
def html_plain_text(spark, d):
    """The limit is the feature: a preview of so many characters."""
    t = table(spark, d, "pages").select("page_id", decode_entities(own_text(F.col("html"))).alias("t"))
    return t.select("page_id", F.when(F.length("t") > MOST_TEXT, F.concat(F.rtrim(F.substring("t", 1, MOST_TEXT)), F.lit("…"))).otherwise(F.col("t")).alias("text"))


@query(f"select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, len(list_filter(string_split({entities_sql(_plain)}, ' '), lambda x: x <> '')) as n_words, len(regexp_extract_all(html, '(?i)<a\\b[^>]*href=[\"'']([^\"'']+)[\"'']', 1)) as n_links from pages")
def html_crawl_content(spark, d):
    """What a crawl stores of a page: title, words and links."""
    html = F.col("html")
    words = F.filter(F.split(decode_entities(own_text(html)), " "), lambda x: x != "")
    links = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.size(words).cast("long").alias("n_words"), F.size(links).cast("long").alias("n_links"))


@query(f"with {SHAPED} select page_id, 0 as table_index, 0 as row_index, ['Name', 'Column 2'] as headers, [trim(t), page_id::varchar] as cells from x", "listings")
def html_detect_tables(spark, d):
    """Tables of two rows and columns or more: headers, named by number where blank, and rows."""
    return detect_tables(rich(spark, d))


# Lists by selectors


LIST_FIELDS = {"name": [".title", "a", "li"], "link": ["a@data-url", "a@href"], "kind": ["value@menu"]}
ITEMS = "i as (select page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1)) as link, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2)) as name, unnest(range(len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1)))) as position from pages)"


@query(f"with {ITEMS} select page_id, position::int as position, trim(regexp_replace({entities_sql('name')}, '\\s+', ' ', 'g')) as name, {entities_sql('link')} as link, 'menu' as kind from i")
def html_scrape_list(spark, d):
    """The items of a selector, and for each field the first of its ranked selectors that gives something."""
    return scrape_ranked(table(spark, d, "pages"), "nav > ul li", LIST_FIELDS).select("page_id", "position", "name", "link", "kind")


@query(f"with {ITEMS} select 'name' as field, 1 as rank, count(*) filter (where name <> '') as wins from i union all select 'link', 1, count(*) filter (where link <> '') from i union all select 'kind', 0, count(*) from i")
def agg_selector_wins(spark, d):
    """How often each ranked selector gave its field's value."""
    rows = scrape_ranked(table(spark, d, "pages"), "nav > ul li", LIST_FIELDS)
    ranks = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_rank").alias("rank")) for f in LIST_FIELDS]))
    return rows.select(ranks.alias("x")).select("x.*").where("rank is not null").groupBy("field", "rank").agg(F.count("*").alias("wins"))


@query(f"with {ITEMS}, wins as (select 'name' as field, 1 as rank, count(*) filter (where name <> '') as wins from i union all select 'name', 2, count(*) filter (where name = '') from i union all select 'link', 1, count(*) filter (where link <> '') from i union all select 'kind', 0, count(*) from i) select field, arg_min(rank, (-wins, rank)) as best from wins where wins > 0 group by field")
def agg_selector_promote(spark, d):
    """The selector of each field to be tried first: the one that won most."""
    wins = agg_selector_wins(spark, d)
    return wins.groupBy("field").agg(F.max_by("rank", F.struct("wins", (-F.col("rank")).alias("r"))).alias("best"))


# Links and the crawl


@query("select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || link as link from (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href=[\"''](/[^\"'']*)[\"'']', 1)) as link from pages)")
def enqueue_links(spark, d):
    """The links of every page, made absolute: what a crawl would ask for next."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*href=[\"'](/[^\"']*)[\"']"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("site"), F.explode(links).alias("link")).select("page_id", F.concat("site", "link").alias("link"))


@query("select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') as url from pages")
def crawl_url_norm(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/$", "").alias("url"))


@query("select page_id, case page_id % 3 when 0 then host = 'x.example.org' when 1 then host = 'example.org' or ends_with(host, 'example.org') else host = 'x.example.org' and starts_with(path, '/en') end and regexp_matches(url, 'example') and not regexp_matches(url, '[?&]page=|/fr/') as allowed from (select page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path from pages)")
def crawl_scope_filter(spark, d):
    """Whether a crawl of a domain, its subdomains or one of its paths may go to a URL, with patterns to include and to exclude."""
    host, path = F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1)
    scope = F.when(F.col("page_id") % 3 == 0, host == "x.example.org").when(F.col("page_id") % 3 == 1, host.endswith("example.org")).otherwise((host == "x.example.org") & path.startswith("/en"))
    include, exclude = F.array(F.lit("example")), F.array(F.lit("[?&]page="), F.lit("/fr/"))
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", (scope & F.exists(include, lambda p: F.regexp(url, p)) & ~F.exists(exclude, lambda p: F.regexp(url, p))).alias("allowed"))


ALLOW, DENY = ("/en/1", "/d*/2?"), ("/en", "/*/9*", "/private", "7$", "/fr/3*8$")


@query("select page_id, path = '' or starts_with(path, '/en/1') or regexp_full_match(path, '/d.*/2.') or not (starts_with(path, '/en') or regexp_full_match(path, '/.*/9.*') or starts_with(path, '/private') or ends_with(path, '7') or regexp_full_match(path, '/fr/3.*8')) as allowed from (select page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path from pages)")
def crawl_robots_filter(spark, d):
    """Rules of a site: what is allowed goes first, then what is not, by prefix, with wild cards, or, with a `$`, by the path's end; `/` alone forbids all."""
    path = F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", robots_allow(path, F.array(*map(F.lit, ALLOW)), F.array(*map(F.lit, DENY))).alias("allowed"))


def robots_allow(path: F.Column, allow: F.Column, deny: F.Column) -> F.Column:
    """Whether rules let a path be visited; a path that is empty always."""
    glob = lambda rule: F.concat(F.lit("^"), F.replace(F.replace(rule, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.when(rule.endswith("$"), "").otherwise("$"))
    hit = lambda rule: path.startswith(rule) | (rule.contains("*") & F.regexp(path, glob(rule)))
    ends = lambda rule: rule.endswith("$") & path.endswith(F.substring(rule, 1, F.length(rule) - 1))
    return (path == "") | F.exists(allow, hit) | ~F.exists(deny, lambda r: (r == "/") | hit(r) | ends(r))


@query("select distinct trim(url) as loc from pages where page_id % 20 < 10")
def crawl_sitemap(spark, d):
    """The URLs of the first ten of each set of sitemaps."""
    maps = table(spark, d, "pages").groupBy((F.col("page_id") % 20).alias("map"), F.floor(F.col("page_id") / 1000).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    found = maps.where("map < 10").select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc"))
    return found.select(F.replace("loc", F.lit("&amp;"), F.lit("&")).alias("loc")).distinct()


OFFSETS, PAGES = ("offset", "start", "startrow", "from"), ("page", "p", "pg")


@query("select page_id, case when regexp_matches(u, '[?&](offset|start|startrow|from)=') then regexp_replace(u, '([?&])(offset|start|startrow|from)=[^&#]*', '\\1\\2=0', 'g') else regexp_replace(u, '([?&]page)=[^&#]*', '\\1=1') end as url from (select page_id, url || case when page_id % 4 = 0 and not contains(url, '#') then case when contains(url, '?') then '&' else '?' end || 'startrow=50' else '' end as u from pages)")
def html_pagination_hint(spark, d):
    """A list's URL set back to its first page: offsets to zero, else the page number to one."""
    extra = F.when((F.col("page_id") % 4 == 0) & ~F.col("url").contains("#"), F.concat(F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("startrow=50"))).otherwise("")
    u = F.concat("url", extra)
    offsets = "|".join(OFFSETS)
    back = F.when(u.rlike(f"[?&]({offsets})="), F.regexp_replace(u, f"([?&])({offsets})=[^&#]*", "$1$2=0")).otherwise(F.regexp_replace(u, "([?&]page)=[^&#]*", "$1=1"))
    return table(spark, d, "pages").select("page_id", back.alias("url"))


@query("select row_number() over (partition by host order by page_id) as position, host, regexp_replace(title, '^[A-Z][a-z]{2} [0-9]+, [0-9]{4} — ', '') as title, page_id from listings qualify position <= 10", "listings")
def search_results(spark, d):
    """Results of a site search: dates before the titles go, dense positions, ten at most."""
    rows = listings(spark, d).withColumn("title", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Jan 3, 2024 — "), "title")).otherwise(F.col("title")))
    position = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    return rows.select(position.alias("position"), "host", F.regexp_replace("title", "^[A-Z][a-z]{2} [0-9]+, [0-9]{4} — ", "").alias("title"), "page_id").where("position <= 10")
