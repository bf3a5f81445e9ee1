"""Which provider an address belongs to, its interface's address and the company: rules as rows, the first that fits wins.

A rule has patterns for host, path and the query pairs that may name a posting, and templates over what they found; all
rules of a kind are one expression over the parts of an address, which are taken apart once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions.cleaners import let
from harvestry.plans.views import table
from harvestry.registry import query


class Rule(NamedTuple):
    """h1, p1 and so on are what the groups of the patterns found, q the first of the pairs `asked` that is not blank and fits `q_fits`. A rule whose templates lack a part does not fit. ^ before a name: as a title."""

    provider: str
    host: str
    path: str
    api: str
    company: str
    asked: tuple[str, ...] = ()
    q_fits: str = "."
    not_path: str = "^$"


#: Hosts that stand for a provider's board, employers that own hosts or tenants, names of locales in paths.
VANITY = {"stripe.com": "stripe", "asana.com": "asana", "okta.com": "okta", "github.com": "github", "github.careers": "github", "docusign.com": "docusign", "careers.docusign.com": "docusign", "jobs.twilio.com": "twilio", "twilio.com": "twilio"}
TENANTS = {"td": "TD", "mtb": "M&T Bank", "intel": "Intel"}
LOCALE = "(?:(?i:en|fr|de|es|pt|zh|ja|ko|it|nl|sv|da|fi|pl|tr)(?:-[A-Za-z]{2})?|(?i:wday|cxs))"
SITE = rf"^(?:/{LOCALE}(?=/|$))*+/((?!(?i:job|jobs|details)(?:/|$))[^/]+)"
GREENHOUSE, LEVER, SMART, ASHBY = "https://boards-api.greenhouse.io/v1/boards/", "https://api.lever.co/v0/postings/", "https://api.smartrecruiters.com/v1/companies/", "https://api.ashbyhq.com/posting-api/job-board/{p1}?includeCompensation=true"
ORACLE = "/hcmRestApi/resources/latest/recruitingCEJobRequisition"
FINDER = "Details?expand=all&onlyData=true&finder=ById%3BId%3D%22{p2}%22%2CsiteNumber%3D{p1}"
#: Addresses of postings.
POSTINGS = (
    Rule("greenhouse", r"greenhouse\.io", r"^(?:/(?!jobs/)[^/]+)*?/((?!jobs/)[^/]+)/jobs/([0-9]+)(?:/|$)", GREENHOUSE + "{p1}/jobs/{p2}", "{p1}"),
    Rule("greenhouse", "vanity", "", GREENHOUSE + "{v}/jobs/{q}", "{v}", ("gh_jid",), "^[0-9]+$"),
    Rule("greenhouse", "vanity", r"(?i)/careers/listing/[^/]+/([0-9]+)$", GREENHOUSE + "{v}/jobs/{p1}", "{v}"),
    Rule("greenhouse", "vanity", r"(?i)/jobs/(?:listing/)?[^/]+/([0-9]+)$", GREENHOUSE + "{v}/jobs/{p1}", "{v}"),
    Rule("lever", r"\.lever\.co$", "^/([^/]+)/([^/]+)", LEVER + "{p1}/{p2}", "{p1}"),
    Rule("ashby", r"^jobs\.ashbyhq\.com$", "^/([^/]+)", ASHBY, "{p1}{-q}", ("ashby_jid", "jobId")),
    Rule("ashby", r"^jobs\.ashbyhq\.com$", "^/([^/]+)/(?!application(?:/|$))[^/]+", ASHBY, "{p1}"),
    Rule("workable", r"workable\.com", "^(?=/([^/]+))(?:/(?!j/)[^/]+)*?/j/([^/]+)", "https://apply.workable.com/api/v1/widget/accounts/{p1}/jobs/{p2}", "{p1}"),
    Rule("smartrecruiters", r"smartrecruiters\.com", "^/([^/]+)(?:/[^/]+)*?/([^/]+)$", SMART + "{p1}/postings/{p2}", "{p1}"),
    Rule("recruitee", r"^(.+)\.recruitee\.com$", "^(?:/(?!o/)[^/]+)*?/o/([^/]+)", "https://{h1}.recruitee.com/api/offers/{p1}", "{h1}"),
    Rule("recruitee", r"^(.+)\.recruitee\.com$", "^/([^/]+)", "https://{h1}.recruitee.com/api/offers/{p1}", "{h1}", not_path="/o(?:/|$)"),
    Rule("oraclecloud", r"^careers\.oracle\.com$", "/sites/([^/]+)(?=/).*?/job/([0-9]+)(?:/|$)", "https://eeho.fa.us2.oraclecloud.com" + ORACLE + FINDER, "Oracle"),
    Rule("oraclecloud", r"^([^.]+)(?:\..*)?\.fa(?:\.ocs)?\.oraclecloud\.com$", "(?i)/hcmUI/CandidateExperience/(?:.*/)?(?-i:sites)/([^/]+)(?:/.*)?/(?:job|preview)/([^/]+)", "https://{h}" + ORACLE + FINDER, "^{h1}"),
    Rule("googlecareers", r"(?:^|\.)google\.com$", "(?i)/about/careers/applications/jobs/results/.", "{google}", "Google"),
    Rule("ibmcareers", r"^careers\.ibm\.com$|^ibmglobal\.avature\.net$", "(?i)JobDetail", "{bare}", "IBM{-q}", ("jobId",)),
    Rule("workday", r"^(?:careers\.)?salesforce\.com$", r"(?i)\bjr[0-9]+\b", "https://salesforce.wd12.myworkdayjobs.com/wday/cxs/salesforce/External_Career_Site", "Salesforce"),
    Rule("workday", r"^([a-z0-9-]+)\.wd[0-9]+\.myworkdayjobs\.com$", SITE + r"/(?:.*/)?(?i:job|jobs|details)(?:/|$)", "https://{h}/wday/cxs/{h1}/{p1}", "{tenant}"),
    Rule("eightfold", r"^(.*?)\.?eightfold\.ai$", "", "https://{h}/api/apply/v2/jobs/{q}", "^{h1}", ("pid", "position_id"), "^[0-9]+$"),
    Rule("eightfold", r"^(.*?)\.?eightfold\.ai$", "(?i)/(?:careers/)?(?:job|positions?)/([0-9]+)", "https://{h}/api/apply/v2/jobs/{p1}", "^{h1}"),
    Rule("icims", r"^(?:(?:staff|careers)-)?([^.]+)(?:\..*)?\.icims\.com$", "^(?:/(?!(?i:jobs)/)[^/]+)*/(?i:jobs)/([0-9]+)(?:/|$)", "https://{h}/jobs/{p1}/job", "^{h1}"),
    Rule("taleo", r"^([^.]+)(?:\..*)?\.taleo\.net$", "", "{bare}", "^{h1}{-q}", ("job", "rid", "requisitionId")),
    Rule("njoyn", r"^([^.]+)(?:\..*)?\.njoyn\.com$", "", "{bare}", "^{h1}{-q}", ("JobID", "jobid")),
)
#: Addresses of boards. A board on an employer's own host, which only its page can tell, is none of these.
BOARDS = (
    Rule("greenhouse", r"greenhouse\.io", r"^(?:/(?!jobs(?:/|$))[^/]+)*?/((?!jobs(?:/|$))[^/]+)/jobs(?:/|$)", GREENHOUSE + "{p1}/jobs?content=true", "{p1}", not_path="(?i)^(?:/[^/]+)*?/(?:embed|v1|api)/jobs(?:/|$)"),
    Rule("greenhouse", r"greenhouse\.io", "^/([^/]+)", GREENHOUSE + "{p1}/jobs?content=true", "{p1}", not_path="(?i)^/(?:embed|v1|api)(?:/|$)|^/.+/jobs(?:/|$)"),
    Rule("lever", r"^(?!api\.).*\.lever\.co$", "^/([^/]+)", LEVER + "{p1}?mode=json", "{p1}"),
    Rule("ashby", r"^jobs\.ashbyhq\.com$", "^/([^/]+)", ASHBY, "{p1}"),
    Rule("smartrecruiters", r"^(?!api\.).*smartrecruiters\.com", "^/([^/]+)", SMART + "{p1}/postings", "{p1}", not_path="^/v1(?:/|$)"),
    Rule("oraclecloud", r"^([^.]+)(?:\..*)?\.fa(?:\.ocs)?\.oraclecloud\.com$", "(?i)/hcmUI/CandidateExperience/.*sites/([^/]+)/(?:jobs|requisitions)(?:/|$)", "https://{h}" + ORACLE + "s", "^{h1}{-p1}"),
    Rule("bankofamerica", r"^careers\.bankofamerica\.com$", "", "https://{h}/services/jobssearchservlet", "Bank of America"),
)
EXTRA = (
    Rule("workday", r"^([a-z0-9-]+)\.wd[0-9]+\.myworkdayjobs\.com$", SITE, "https://{h}/wday/cxs/{h1}/{p1}/jobs", "{tenant}"),
    Rule("workable", r"^apply\.workable\.com$", "^/([^/]+)", "https://apply.workable.com/api/v1/widget/accounts/{p1}", "^{p1}", not_path="(?i)^/(?:api|j)(?:/|$)"),
    Rule("workable", r"^(?!apply\.)([^.]+)(?:\..*)?\.workable\.com$", "", "https://apply.workable.com/api/v1/widget/accounts/{h1}", "^{h1}", not_path="^$"),
    Rule("recruitee", r"^([a-z0-9-]+)\.recruitee\.com$", "", "https://{h1}.recruitee.com/api/offers/", "^{h1}"),
    Rule("bamboohr", r"^([a-z0-9-]+)\.bamboohr\.com$", "", "https://{h1}.bamboohr.com/careers/list", "^{h1}"),
    Rule("personio", r"^([a-z0-9-]+)\.jobs\.personio\.(com|de|es|fr|nl)$", "", "https://{h1}.jobs.personio.{h2}/xml", "^{h1}"),
    Rule("breezy", r"^([a-z0-9-]+)\.breezy\.hr$", "", "https://{h1}.breezy.hr/json", "^{h1}"),
    Rule("googlecareers", r"(?:^|\.)google\.com$", "(?i)/about/careers/applications/jobs/results$", "{google}", "Google"),
    Rule("ibmcareers", r"^careers\.ibm\.com$|^ibmglobal\.avature\.net$", "(?i)SearchJobs", "{bare}", "IBM", not_path="(?i)JobDetail"),
)


def titled(c: Column) -> Column:
    """A token as a name: three letters or fewer are capitals, others begin with one."""
    return F.when(F.length(c) <= 3, F.upper(c)).otherwise(F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 20)))


def address(url: Column) -> Column:
    """The parts of an http address: h (host, lower case, without www.), path (without empty parts and a last slash), pairs, bare (without a fragment). Null if it is none."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(u, r"^(?i:https?)://[^/?#]+([^?#]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.contains("="))
    return F.when(host != "", F.struct(F.regexp_replace(host, r"^www\.", "").alias("h"), F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "").alias("path"), pairs.alias("pairs"), F.regexp_replace(u, "#.*$", "").alias("bare")))


def of_map(known: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key)


def applied(rule: Rule, a: Column) -> Column:
    """provider, api and company if a rule fits the parts of an address, else null."""

    def first_asked(name: str) -> Column:
        return F.get(F.filter(F.transform(F.filter(a["pairs"], lambda p: p.startswith(name + "=")), lambda p: F.trim(F.substring(p, len(name) + 2, 1 << 20))), lambda v: v != ""), F.lit(0))

    def part(name: str) -> Column:
        if name[0] in "hp" and name[1:].isdigit():
            return F.nullif(F.regexp_extract(a["h"] if name[0] == "h" else a["path"], rule.host if name[0] == "h" else rule.path, int(name[1:])), F.lit(""))
        return {
            "h": lambda: a["h"], "bare": lambda: a["bare"], "v": lambda: of_map(VANITY, a["h"]), "google": lambda: F.regexp_replace(a["bare"], "://(?i:google)[.]", "://www.google."),
            "q": lambda: F.coalesce(*[first_asked(n) for n in rule.asked]), "tenant": lambda: F.coalesce(of_map(TENANTS, part("h1")), titled(part("h1"))),
        }[name]()

    def filled(template: str) -> Column:
        """{name} puts a part in, {-name} only asks for it."""
        pieces, rest = [], template.removeprefix("^")
        while "{" in rest:
            text, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            pieces += [F.lit(text), F.when(part(name[1:]).isNotNull(), "") if name.startswith("-") else part(name)]
        whole = F.concat(*pieces, F.lit(rest))
        return titled(whole) if template.startswith("^") else whole

    fits = of_map(VANITY, a["h"]).isNotNull() if rule.host == "vanity" else a["h"].rlike(rule.host)
    fits = fits & (a["path"].rlike(rule.path) if rule.path else F.lit(True)) & (~a["path"].rlike(rule.not_path) if rule.not_path != "^$" else F.lit(True))
    if rule.asked:
        fits = fits & F.coalesce(part("q").rlike(rule.q_fits), F.lit(False))
    return F.when(fits, let(F.struct(F.lit(rule.provider).alias("provider"), filled(rule.api).alias("api"), filled(rule.company).alias("company")), lambda x: F.when(x["api"].isNotNull() & x["company"].isNotNull(), x)))


def detected(url: Column, rules: tuple[Rule, ...]) -> Column:
    """provider, api and company of an address by the first rule that fits it; null if none does."""
    return let(address(url), lambda a: F.coalesce(*[applied(r, a) for r in rules]))


# Queries: addresses of every shape, made with each page's number and first word of its host


SHAPES = (
    "https://boards.greenhouse.io/{w}/jobs/{i}?t=1", "https://boards.eu.greenhouse.io/embed/{w}/jobs/x{i}", "https://www.stripe.com/jobs/search?gh_jid={i}", "https://stripe.com/careers/listing/{w}/{i}/", "https://okta.com/jobs/{w}",
    "https://jobs.lever.co/{w}/{i}#apply", "https://api.lever.co/{w}", "https://jobs.ashbyhq.com/{w}/application?jobId={i}", "https://jobs.ashbyhq.com/{w}/application", "https://jobs.ashbyhq.com/{w}/{i}",
    "https://apply.workable.com/{w}/j/A{i}/", "https://{w}.workable.com/jobs", "https://jobs.smartrecruiters.com/{w}/x/{i}", "https://{w}.recruitee.com/l/en/o/{i}", "https://{w}.recruitee.com/{i}",
    "https://careers.oracle.com/en/sites/jobsearch/job/{i}", "https://{w}.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/preview/job/{i}", "https://{w}.fa.ocs.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/requisitions", "https://google.com/about/careers/applications/jobs/results/{i}-x?q=1#f",
    "https://www.google.com/about/careers/applications/jobs/results/", "https://careers.ibm.com/en_US/careers/JobDetail?jobId={i}", "https://careers.ibm.com/en_US/careers/SearchJobs/?jobId={i}", "https://salesforce.com/company/careers/jobs/JR{i}/",
    "https://td.wd3.myworkdayjobs.com/en-US/{w}/job/Rome/{i}", "https://{w}.wd3.myworkdayjobs.com/fr/jobs/{i}", "https://{w}.eightfold.ai/careers?pid={i}", "https://{w}.eightfold.ai/careers/job/{i}", "https://careers-{w}.icims.com/jobs/{i}/login", "https://{w}.taleo.net/careersection/x?job={i}#a",
    "https://cgi.njoyn.com/x?JobID={i}", "https://{w}.bamboohr.com/jobs/", "https://{w}.jobs.personio.de/job/{i}", "https://{w}.breezy.hr/p/{i}", "https://careers.bankofamerica.com/en-us", "https://{w}.example.org/jobs/{i}", "ftp://jobs.lever.co/{w}/{i}", "not an address",
)
_made = "addresses as (select page_id, replace(replace([" + ", ".join(f"'{s}'" for s in SHAPES) + f"][page_id % {len(SHAPES)} + 1], '{{w}}', w), '{{i}}', (page_id + 1000)::varchar) as u from (select page_id, lower(regexp_extract(url, '^https?://(?:m[.]|www[.])?([^./]+)', 1)) as w from pages))"
_parts = """parts as (select page_id, regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '^www[.]', '') as h, list_filter(string_split(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') as s,
  list_filter(string_split(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: contains(x, '=')) as q, regexp_replace(u, '#.*$', '') as bare from addresses),
p as (select *, split_part(h, '.', 1) as h1, list_position(s, 'jobs') as jobs, list_position(s, 'job') as job, list_position(s, 'sites') as sites, list_position(s, 'o') as o, list_position(s, 'j') as j,
  list_filter(s, lambda x: not regexp_full_match(x, '(?i)(en|fr|de|es|pt|zh|ja|ko|it|nl|sv|da|fi|pl|tr)(-[a-z]{2})?|wday|cxs')) as site,
  list_filter(q, lambda x: regexp_matches(x, '^(gh_jid|jobId|ashby_jid|pid|position_id|job|rid|requisitionId|JobID)=.'))[1] as pair from parts),
x as (select *, split_part(pair, '=', 1) as k, split_part(pair, '=', 2) as v, site[1] as place from p)"""
_title = lambda c: f"case when length({c}) <= 3 then upper({c}) else upper(left({c}, 1)) || substr({c}, 2) end"
_tenant = f"case h1 when 'td' then 'TD' when 'mtb' then 'M&T Bank' when 'intel' then 'Intel' else {_title('h1')} end"
_board = "{'stripe.com': 'stripe', 'okta.com': 'okta'}"
_finder = "Details?expand=all&onlyData=true&finder=ById%3BId%3D%22"


def _case(rows: list[tuple[str, str, str, str]]) -> str:
    whens = " ".join(f"when {test} then {{'provider': '{provider}', 'api': {api}, 'company': {company}}}" for provider, test, api, company in rows)
    return f"select page_id, f.provider, f.api, f.company from (select page_id, case {whens} end as f from x)"


_POSTING_SQL = _case([
    ("greenhouse", "contains(h, 'greenhouse.io') and jobs > 1 and regexp_full_match(s[jobs + 1], '[0-9]+')", f"'{GREENHOUSE}' || s[jobs - 1] || '/jobs/' || s[jobs + 1]", "s[jobs - 1]"),
    ("greenhouse", "h in ('stripe.com', 'okta.com') and k = 'gh_jid' and regexp_full_match(v, '[0-9]+')", f"'{GREENHOUSE}' || h1 || '/jobs/' || v", "h1"),
    ("greenhouse", "h in ('stripe.com', 'okta.com') and s[1] = 'careers' and s[2] = 'listing' and regexp_full_match(s[4], '[0-9]+')", f"'{GREENHOUSE}' || h1 || '/jobs/' || s[4]", "h1"),
    ("lever", "ends_with(h, '.lever.co') and len(s) > 1", f"'{LEVER}' || s[1] || '/' || s[2]", "s[1]"),
    ("ashby", "h = 'jobs.ashbyhq.com' and (k = 'jobId' or s[2] <> 'application')", f"replace('{ASHBY}', '{{p1}}', s[1])", "s[1]"),
    ("workable", "contains(h, 'workable.com') and j > 0 and len(s) > j", "'https://apply.workable.com/api/v1/widget/accounts/' || s[1] || '/jobs/' || s[j + 1]", "s[1]"),
    ("smartrecruiters", "contains(h, 'smartrecruiters.com') and len(s) > 1", f"'{SMART}' || s[1] || '/postings/' || s[-1]", "s[1]"),
    ("recruitee", "ends_with(h, '.recruitee.com') and coalesce(s[o + 1], s[1]) is not null", "'https://' || h || '/api/offers/' || coalesce(s[o + 1], s[1])", "replace(h, '.recruitee.com', '')"),
    ("oraclecloud", "h = 'careers.oracle.com' and sites > 0 and regexp_full_match(s[job + 1], '[0-9]+')", f"'https://eeho.fa.us2.oraclecloud.com{ORACLE}{_finder}' || s[job + 1] || '%22%2CsiteNumber%3D' || s[sites + 1]", "'Oracle'"),
    ("oraclecloud", "regexp_matches(h, '[.]fa([.]ocs)?[.]oraclecloud[.]com$') and contains(bare, '/hcmUI/CandidateExperience/') and sites > 0 and job > 0", f"'https://' || h || '{ORACLE}{_finder}' || s[job + 1] || '%22%2CsiteNumber%3D' || s[sites + 1]", _title("h1")),
    ("googlecareers", "h = 'google.com' and contains(bare, '/jobs/results/') and s[6] is not null", "regexp_replace(bare, '://google', '://www.google')", "'Google'"),
    ("ibmcareers", "h = 'careers.ibm.com' and contains(bare, 'JobDetail') and k = 'jobId'", "bare", "'IBM'"),
    ("workday", "h = 'salesforce.com' and regexp_matches(bare, '/JR[0-9]')", "'https://salesforce.wd12.myworkdayjobs.com/wday/cxs/salesforce/External_Career_Site'", "'Salesforce'"),
    ("workday", "ends_with(h, '.myworkdayjobs.com') and len(list_filter(site[2:], lambda y: lower(y) in ('job', 'jobs', 'details'))) > 0 and lower(place) not in ('job', 'jobs', 'details')", "'https://' || h || '/wday/cxs/' || h1 || '/' || place", _tenant),
    ("eightfold", "ends_with(h, '.eightfold.ai') and (k = 'pid' or job > 0)", "'https://' || h || '/api/apply/v2/jobs/' || coalesce(v, s[job + 1])", _title("h1")),
    ("icims", "ends_with(h, '.icims.com') and regexp_full_match(s[jobs + 1], '[0-9]+')", "'https://' || h || '/jobs/' || s[jobs + 1] || '/job'", _title("regexp_replace(h1, '^(staff|careers)-', '')")),
    ("taleo", "ends_with(h, '.taleo.net') and k = 'job'", "bare", _title("h1")),
    ("njoyn", "ends_with(h, '.njoyn.com') and k = 'JobID'", "bare", _title("h1")),
])
_EXTRA_ROWS = [
    ("workday", "ends_with(h, '.myworkdayjobs.com') and lower(place) not in ('job', 'jobs', 'details')", "'https://' || h || '/wday/cxs/' || h1 || '/' || place || '/jobs'", _tenant),
    ("workable", "h = 'apply.workable.com' and s[1] not in ('api', 'j')", "'https://apply.workable.com/api/v1/widget/accounts/' || s[1]", _title("s[1]")),
    ("workable", "h <> 'apply.workable.com' and ends_with(h, '.workable.com')", "'https://apply.workable.com/api/v1/widget/accounts/' || h1", _title("h1")),
    ("recruitee", "regexp_full_match(h, '[a-z0-9-]+[.]recruitee[.]com')", "'https://' || h || '/api/offers/'", _title("h1")),
    ("bamboohr", "regexp_full_match(h, '[a-z0-9-]+[.]bamboohr[.]com')", "'https://' || h || '/careers/list'", _title("h1")),
    ("personio", "regexp_full_match(h, '[a-z0-9-]+[.]jobs[.]personio[.](com|de|es|fr|nl)')", "'https://' || h || '/xml'", _title("h1")),
    ("breezy", "regexp_full_match(h, '[a-z0-9-]+[.]breezy[.]hr')", "'https://' || h || '/json'", _title("h1")),
    ("googlecareers", "h = 'google.com' and s[-1] = 'results'", "regexp_replace(bare, '://google', '://www.google')", "'Google'"),
    ("ibmcareers", "h = 'careers.ibm.com' and contains(bare, 'SearchJobs')", "bare", "'IBM'"),
]
_BOARD_ROWS = [
    ("greenhouse", "contains(h, 'greenhouse.io') and coalesce(s[jobs - 1], s[1]) not in ('embed', 'v1', 'api')", f"'{GREENHOUSE}' || coalesce(s[jobs - 1], s[1]) || '/jobs?content=true'", "coalesce(s[jobs - 1], s[1])"),
    ("lever", "ends_with(h, '.lever.co') and h <> 'api.lever.co' and len(s) > 0", f"'{LEVER}' || s[1] || '?mode=json'", "s[1]"),
    ("ashby", "h = 'jobs.ashbyhq.com' and len(s) > 0", f"replace('{ASHBY}', '{{p1}}', s[1])", "s[1]"),
    ("smartrecruiters", "contains(h, 'smartrecruiters.com') and s[1] <> 'v1'", f"'{SMART}' || s[1] || '/postings'", "s[1]"),
    ("oraclecloud", "regexp_matches(h, '[.]fa([.]ocs)?[.]oraclecloud[.]com$') and sites > 0 and s[sites + 2] in ('jobs', 'requisitions')", f"'https://' || h || '{ORACLE}s'", _title("h1")),
    ("bankofamerica", "h = 'careers.bankofamerica.com'", "'https://' || h || '/services/jobssearchservlet'", "'Bank of America'"),
]


def routed(spark, d, rules):
    word = F.lower(F.regexp_extract("url", r"^https?://(?:m[.]|www[.])?([^./]+)", 1))
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("page_id") % len(SHAPES) + 1).cast("int"))
    url = F.replace(F.replace(shape, F.lit("{w}"), word), F.lit("{i}"), (F.col("page_id") + 1000).cast("string"))
    return table(spark, d, "pages").select("page_id", url.alias("u")).select("page_id", detected(F.col("u"), rules).alias("f")).select("page_id", "f.provider", "f.api", "f.company")


@query(f"with {_made}, {_parts} {_POSTING_SQL}")
def src_ats_detect(spark, d):
    return routed(spark, d, POSTINGS)


@query(f"with {_made}, {_parts} {_case(_BOARD_ROWS + _EXTRA_ROWS)}")
def src_ats_board_detect(spark, d):
    """Boards by the main rules, then by those of single providers."""
    return routed(spark, d, BOARDS + EXTRA)


@query(f"with {_made}, {_parts} {_case(_EXTRA_ROWS)}")
def src_board_extra_detect(spark, d):
    return routed(spark, d, EXTRA)


@query(f"with {_made}, {_parts}, f as ({_case(_EXTRA_ROWS)}) select page_id, provider = 'workday' as workday, provider = 'workable' as workable, provider = 'recruitee' as recruitee, provider = 'bamboohr' as bamboohr, provider = 'personio' as personio, provider = 'breezy' as breezy, provider = 'googlecareers' as googlecareers, provider = 'ibmcareers' as ibmcareers from f where provider is not null")
def hp_board_detect_each(spark, d):
    """Each provider's rules by themselves, for the addresses that one of them fits."""
    word = sorted({r.provider for r in EXTRA})
    rows = routed(spark, d, EXTRA).where("provider is not null")
    return rows.select("page_id", *[(F.col("provider") == p).alias(p) for p in word])


@query(f"with {_made}, {_parts}, f as ({_POSTING_SQL}) select page_id, api, company from f join x using (page_id) where provider = 'greenhouse' and h in ('stripe.com', 'okta.com')")
def hp_board_gh_vanity(spark, d):
    return routed(spark, d, tuple(r for r in POSTINGS if r.host == "vanity")).where("provider is not null").select("page_id", "api", "company")


@query(f"with {_made}, {_parts}, f as ({_POSTING_SQL}) select page_id, api, company from f join x using (page_id) where provider = 'workday' and ends_with(h, '.myworkdayjobs.com')")
def hp_board_workday(spark, d):
    return routed(spark, d, tuple(r for r in POSTINGS if "myworkdayjobs" in r.host)).where("provider is not null").select("page_id", "api", "company")
