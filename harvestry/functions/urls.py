"""Canonical URLs and keys, in native expressions for well-formed http(s) URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that track visitors, or that page, sort and filter lists; neither names a posting.
TRACKING = "utm_.*|fbclid|gclid|gbraid|wbraid|mc_eid|mc_cid|_ga|_gl|ref|src|trk|si|igshid|mkt_tok"
NOISE = "page|pagesize|page_size|p|start|offset|from|size|limit|hl|lang|language|locale|q|query|search|keywords|keyword|location|locations|loc|city|country|state|remote|sort|sortby|order|orderby|filter|filters|facet|category|department|team"
DROPPED = f"^({TRACKING}|{NOISE})$"
#: Hosts that keep www, as they send visitors without it elsewhere; and where the path alone names a posting.
WWW = ("careers.ford.com",)
PATH_ONLY_HOST, PATH_ONLY = r"(^|\.)google\.com$", r"(?i)/about/careers/applications/jobs/results/[0-9]+"
REPEATED, ONCE = r"(/about/careers/applications/jobs)(?:/jobs)?/results(?:/jobs/results)*([/?#]|$)", "{0}1/results{0}2"
_HOST = r"^https?://(?:[^/?#@]*@)?([^/?#:]+)"
_PORT = r"^https?://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)"
_PATH = r"^https?://[^/?#]+([^?#]*)"
_QUERY = r"^[^?#]*[?]([^#]*)"


def host(url: Column) -> Column:
    """Host in lower case without www., null if the URL is not http(s)."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.", ""), F.lit(""))


def normalized(url: Column) -> Column:
    """https, host without www. (but for a few), any port but the default ones, path without its last slash, and the query pairs that are left, in order; null if there is no host.

    A URL without a scheme gets https; a fragment, a user name and a repeated path segment go. Percent codes stay as they are.
    """
    raw = F.trim(url)
    full = F.when(raw.rlike("(?i)^https?://"), F.concat(F.lower(F.regexp_extract(raw, "^([A-Za-z]+)://", 1)), F.regexp_extract(raw, "^[A-Za-z]+(://.*)$", 1))).when(~raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (raw != ""), F.concat(F.lit("https://"), raw))
    full = F.regexp_replace(full, REPEATED, ONCE.format("$"))
    name, port = host(full), F.regexp_extract(full, _PORT, 1)
    place = F.concat(F.when(name.isin(*WWW), F.lit("www.")).otherwise(""), name, F.when((port == "") | (port == "443") | ((port == "80") & full.startswith("http:")), "").otherwise(F.concat(F.lit(":"), port)))
    path = F.regexp_extract(full, _PATH, 1)
    path = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(full, _QUERY, 1), "&"), lambda x: (x != "") & ~F.lower(F.split(x, "=")[0]).rlike(DROPPED)))
    query = F.when((F.size(pairs) > 0) & ~(name.rlike(PATH_ONLY_HOST) & path.rlike(PATH_ONLY)), F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.concat(F.lit("https://"), place, path, query)


def normalized_sql(column: str) -> str:
    full = f"case when regexp_matches(trim({column}), '^(?i)https?://') then lower(regexp_extract(trim({column}), '^([A-Za-z]+)://', 1)) || regexp_extract(trim({column}), '^[A-Za-z]+(://.*)$', 1) when not regexp_matches(trim({column}), '^[A-Za-z][A-Za-z0-9+.-]*:') and trim({column}) <> '' then 'https://' || trim({column}) end"
    full = f"regexp_replace({full}, '{REPEATED}', '{ONCE.format(chr(92))}')"
    name, port = f"nullif(regexp_replace(lower(regexp_extract({full}, '{_HOST}', 1)), '^www\\.', ''), '')", f"regexp_extract({full}, '{_PORT}', 1)"
    path = f"regexp_extract({full}, '{_PATH}', 1)"
    pairs = f"list_sort(list_filter(string_split(regexp_extract({full}, '{_QUERY}', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(split_part(x, '=', 1)), '{DROPPED}')))"
    www = ", ".join(f"'{h}'" for h in WWW)
    return f"""'https://' || case when {name} in ({www}) then 'www.' else '' end || {name} || case when {port} in ('', '443') or ({port} = '80' and {full} like 'http:%') then '' else ':' || {port} end
        || case when {path} = '' then '/' when length({path}) > 1 and {path} like '%/' then left({path}, length({path}) - 1) else {path} end
        || case when len({pairs}) > 0 and not (regexp_matches({name}, '{PATH_ONLY_HOST}') and regexp_matches({path}, '{PATH_ONLY}')) then '?' || array_to_string({pairs}, '&') else '' end"""


def key(url: Column) -> Column:
    return F.sha2(normalized(url), 256)
