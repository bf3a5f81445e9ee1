"""Salary and place cleaners, repairs that apply them to all listings, board addresses and cron fires, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import cleaners as C
from harvestry.functions.text import entities_sql
from harvestry.operators.helpers import pick, pick_sql
from harvestry.operators.records import NOW_MS
from harvestry.plans.views import robots, table
from harvestry.registry import query

SALARIES = (
    "$50,000 - $72,500.00 per year", "Texas: $80,000 — $95,000. In the California metro area $100,000.50 to $130,000", "New York $ 120,000.00 – $150,000; elsewhere $90,000 to $110,000.10", "£45.50 per hour",
    "€3000 month", " $ 55,000 annum ", "competitive", "", None, "Pay depends on experience, place and skills, as agreed with the whole team", "₹12,00,000 yr or more", "$18.00", "$20-$25/hr",
)
PLACES = (
    "Seattle, WA", "Oklahoma City, OK, United States", "CAO01: Plant, 4345 Southpark Ave, Oklahoma City, OK, 73127", "Austin, Texas | austin, texas | Remote", "New York, ny, USA", "Paris, France", None, " ", "St. Louis, MO",
    "Dr. Martin Road 5, ABC Site", "San Jos&eacute;, CA | Reno, Nevada , U.S.", "AB12: 12 Main Street Floor 3, Denver, CO | 10 Downing Street", "Boston &amp; Cambridge, Massachusetts, United States of America", "Main Campus of the Company with a Very Long Name, Building Nine, Tampa, FL",
    "XY-Ville, Bern, Switzerland", "Tulsa, OK-West", "Washington, District of Columbia",
)
_salary, _place = pick_sql("page_id", *SALARIES), pick_sql("(page_id // 2)", *PLACES)
_codes, _names = (", ".join(f"'{x}'" for x in xs) for xs in (C.STATES, [n.lower() for n in C.STATES.values()]))
_q = lambda p: p.replace("'", "''")


def raw_fields(spark, d):
    """page_id, salary and location as pages state them: texts of all the shapes that the cleaners tell apart."""
    return table(spark, d, "pages").select("page_id", pick(F.col("page_id"), *SALARIES).alias("salary"), pick(F.floor(F.col("page_id") / 2), *PLACES).alias("location"))


_list = lambda xs: "[" + ", ".join(f"'{_q(x)}'" for x in xs) + "]"
_words = lambda c: f"string_split_regex(lower({c}), '[^a-z0-9_]+')"
_street = lambda c: f"list_has_any({_words(c)}, {_list(C.STREETS)})"
_spaced = lambda c: f"string_split_regex({c}, '\\s+')"
_number = lambda c: f"(len(list_filter({_spaced(c)}, lambda w, i: regexp_matches(w, '(^|[^0-9A-Za-z_])[0-9]{{1,6}}$') and regexp_matches(coalesce({_spaced(c)}[i + 1], ''), '^[A-Za-z]'))) > 0 or len(list_filter({_words(c)}, lambda w: regexp_full_match(w, '[0-9]{{5}}'))) > 0)"


def _address_sql(c: str) -> str:
    """The first town and code of the parts of an address, by rows of parts."""
    name, at = _q(C.NAME_END), "string_split({}, ',')".format(c)
    part = lambda i: f"coalesce(trim({at}[{i}]), '')"
    every = f"range(1, len({at}) + 1)"
    zipped = f"list_filter({every}, lambda i: i >= 3 and (regexp_matches({part('i')}, '^[A-Z]{{2}} *[0-9]{{5}}') or (regexp_full_match({part('i')}, '[A-Z]{{2}}') and regexp_matches({part('i + 1')}, '^[0-9]{{5}}'))) and regexp_matches({part('i - 1')}, '^{name}'))[1]"
    coded = f"list_filter({every}, lambda i: i >= 2 and regexp_matches({part('i')}, '{C.CODE}') and regexp_matches({part('i - 1')}, '{name}'))[1]"
    town = f"regexp_extract({part(f'{coded} - 1')}, '{name}')"
    return f"""case when left({part(zipped)}, 2) in ({_codes}) then {part(f'{zipped} - 1')} || ', ' || left({part(zipped)}, 2)
        when left({part(coded)}, 2) in ({_codes}) and not regexp_matches({town}, '^[A-Z]{{2}}') and not {_street(town)} then {town} || ', ' || left({part(coded)}, 2) end"""


_country = "coalesce(list_filter({}, lambda x: ends_with(rtrim(lower(v)), x))[1], '')".format(_list(C.COUNTRIES))
PLACE_SQL = f"""raw as (select page_id, {_salary} as salary, {_place} as location from pages),
    parts as (select page_id, i, string_split_regex(trim(location), '\\s*\\|\\s*')[i] as p from raw, lateral (select unnest(range(1, len(string_split_regex(trim(location), '\\s*\\|\\s*')) + 1)) as i)),
    v0 as (select page_id, i, p, trim({entities_sql('p')}) as e from parts),
    v1 as (select page_id, i, p, case when contains(e, ':') and regexp_full_match(trim(split_part(e, ':', 1)), '[A-Za-z]{{2,6}}[0-9]{{1,4}}') then trim(e[instr(e, ':') + 1:]) else e end as v from v0),
    v2 as (select *, trim(regexp_replace(regexp_replace(case when {_country} = '' then v else regexp_replace(left(rtrim(v), length(rtrim(v)) - length({_country})), ',?\\s*$', '') end, '\\s+,', ',', 'g'), ',\\s*$', '')) as s from v1),
    v3 as (select *, trim(string_split(s, ',')[-1]) as region, trim(array_to_string(string_split(s, ',')[:-2], ',')) as city from v2),
    v4 as (select page_id, i, coalesce(case when {_street('v')} or {_number('v')} then {_address_sql('v')} end,
        case when city <> '' and lower(region) in ({_names}) then city || ', ' || region when city <> '' and upper(region) in ({_codes}) then city || ', ' || upper(region) end,
        case when length(s) > {C.LONGEST} or {_street('s')} then {_address_sql('p')} end, s) as one from v3),
    v5 as (select page_id, min(i) as i, arg_min(one, i) as one from v4 where one <> '' group by page_id, lower(one)),
    placed as (select page_id, salary, coalesce(place, '') as place from raw left join (select page_id, string_agg(one, ' · ' order by i) as place from v5 group by page_id) using (page_id))"""
_bare = f"regexp_replace(regexp_extract(piece, '{C.NUMBER}'), '\\s', '', 'g')"
_dear = f"(list_has_any(list_concat({_words('place')}, list_transform({_words('place')}, lambda w, i: w || coalesce(' ' || {_words('place')}[i + 1], ''))), {_list(C.DEAR_PLACES)}) or list_has_any(string_split_regex(lower(place), '[,\\s]+'), {_list(C.DEAR_CODES)}))"
_unit = "case " + " ".join(f"when {' or '.join(f'starts_with(u, {chr(39)}{w}{chr(39)})' for w in ws)} then ' / {n}'" for n, ws in C.UNITS) + " else '' end"
SALARY_SQL = f"""{PLACE_SQL}, said as (select *, trim(coalesce(salary, '')) as t from placed),
    cutted as (select page_id, place, t, unnest(regexp_extract_all(t, '{C.PIECES}')) as piece, unnest(range(1, len(regexp_extract_all(t, '{C.PIECES}')) + 1)) as i from said),
    tokens as (select *, case when contains({_bare}, '.') then rtrim(rtrim({_bare}, '0'), '.') else {_bare} end as money, piece[length(regexp_extract(piece, '{C.NUMBER}')) + 1:] as after,
        sum(length(piece)) over (partition by page_id order by i) - length(piece) as seen, sum(length(piece)) over (partition by page_id) as total from cutted),
    linked as (select *, lead(money) over w as upper_end, money <> '' and lower(trim(after)) in ('{"', '".join(C.JOINS)}') and coalesce(lead(money) over w, '') <> '' as linked from tokens window w as (partition by page_id order by i)),
    island as (select *, i - row_number() over (partition by page_id order by i) as island from linked where linked),
    begun as (select *, row_number() over (partition by page_id, island order by i) % 2 = 1 as begins from island),
    ranges as (select page_id, i, place, money || ' – ' || upper_end as r, regexp_replace(lower(right(left(t, (length(t) - total + seen)::bigint), {C.BEFORE})), '\\s', '', 'g') as near from begun where begins),
    chosen as (select page_id, arg_min(r, i + case when {_dear} and len(list_filter({_list(C.DEAR_WORDS)}, lambda x: contains(near, x))) > 0 then 0 else 1000 end) as r from ranges group by page_id),
    alone as (select page_id, arg_min(money, i) as money, regexp_replace(lower(ltrim(arg_min(after, i))), '^per\\s+', '') as u from tokens where money <> '' group by page_id),
    paid as (select page_id, place, case when r is not null then r when money is not null then money || {_unit} when length(t) <= {C.PROSE} then t else '' end as pay from said left join chosen using (page_id) left join alone using (page_id))"""


@query(f"with {PLACE_SQL} select page_id, place from placed")
def fn_location_norm(spark, d):
    return raw_fields(spark, d).select("page_id", C.place(F.col("location")).alias("place"))


@query(f"with {SALARY_SQL} select page_id, pay from paid")
def fn_salary_norm(spark, d):
    return raw_fields(spark, d).select("page_id", C.salary_range(F.col("salary"), C.place(F.col("location"))).alias("pay"))


@query(f"with {PLACE_SQL} select raw.page_id, raw.location, place as repaired from raw join placed using (page_id) where coalesce(raw.location, '') <> place")
def hp_repair_locations(spark, d):
    """The listings whose place the cleaner changes, with both texts."""
    rows = raw_fields(spark, d).select("page_id", "location", C.place(F.col("location")).alias("repaired"))
    return rows.where(F.coalesce("location", F.lit("")) != F.col("repaired"))


@query(f"with {SALARY_SQL} select said.page_id, salary, pay as repaired from said join paid using (page_id) where coalesce(salary, '') <> pay")
def hp_repair_salaries(spark, d):
    """The listings whose salary the cleaner changes, with both texts."""
    rows = raw_fields(spark, d).select("page_id", "salary", C.salary_range(F.col("salary"), C.place(F.col("location"))).alias("repaired"))
    return rows.where(F.coalesce("salary", F.lit("")) != F.col("repaired"))


# Board addresses

BOARDS = (
    "https://jobs.findly.com/x", "https://careers.acme.com/Job-Search-Results?q=1", "https://career5.successfactors.eu/career?x=1", "https://jobs.acme.com/search/?q=&startrow=25", "https://jobs.acme.com/search-3?optionsFacetsDD_city=Rome",
    "https://jobs.acme.com/searches?startrow=1", "findly.com/job-search-results", None, "https://jobs.acme.com/go/search/all?a=startrow", "HTTPS://JOBS.ACME.COM/Search?STARTROW=2",
)
ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)(?:\?([^#]*))?"
_board = f"boards as (select page_id, coalesce({pick_sql('page_id', *BOARDS)}, '') as u from pages), b as (select page_id, lower(regexp_extract(u, '{ADDRESS}', 1)) as host, lower(regexp_extract(u, '{ADDRESS}', 2)) as path, regexp_extract(u, '{ADDRESS}', 3) as asked from boards)"


def boards(spark, d):
    u = F.coalesce(pick(F.col("page_id"), *BOARDS), F.lit(""))
    return table(spark, d, "pages").select("page_id", *[f(F.regexp_extract(u, ADDRESS, i)).alias(n) for i, (n, f) in enumerate([("host", F.lower), ("path", F.lower), ("asked", lambda c: c)], 1)])


@query(f"with {_board} select page_id, contains(host, 'findly.com') or (host <> '' and contains(path, '/job-search-results')) as findly from b")
def hp_board_findly_like(spark, d):
    own = F.col("host").contains("findly.com") | ((F.col("host") != "") & F.col("path").contains("/job-search-results"))
    return boards(spark, d).select("page_id", own.alias("findly"))


@query(f"with {_board} select page_id, regexp_matches(host, 'successfactors\\.(com|eu)') or (host <> '' and regexp_matches(path, '/search(-[0-9]+)?(/|$)') and len(list_filter(string_split(asked, '&'), lambda x: string_split(x, '=')[1] = 'startrow' or starts_with(lower(x), 'optionsfacetsdd_'))) > 0) as sf from b")
def hp_board_sf_like(spark, d):
    """A search page whose query names a start row or a facet, or the provider's own host."""
    asks = F.col("asked").rlike(r"(?:^|&)(?:startrow(?:=|&|$)|(?i:optionsfacetsdd_))")
    own = F.col("host").rlike(r"successfactors\.(?:com|eu)") | ((F.col("host") != "") & F.col("path").rlike(r"/search(?:-[0-9]+)?(?:/|$)") & asks)
    return boards(spark, d).select("page_id", own.alias("sf"))


# Cron fires

CRONS = ("0 0 * * *", " */15  * * * *", "30 6 * * 1-5", "0 */6 1,15 * *", "5 4 29 2 *", "0 12 1 * 7", "bad", "*/5 8-10 * 3 *", "", "61 * * * *", "10,20 5/9 * * *", None, "0 0 31 2 *")
LEAST_GAP = 15 * 60_000


def _hit(field: int, v: str, low: int, high: int) -> str:
    base, first = "string_split(p, '/')[1]", f"case when starts_with(p, '*') then {low} else try_cast(string_split(string_split(p, '/')[1], '-')[1] as int) end"
    last = f"case when starts_with(p, '*') or (contains(p, '/') and not contains({base}, '-')) then {high} when contains({base}, '-') then try_cast(string_split({base}, '-')[2] as int) else {first} end"
    return f"coalesce(list_bool_or(list_transform(string_split(string_split(cron, ' ')[{field}], ','), lambda p: {v} between {first} and {last} and ({v} - {first}) % coalesce(try_cast(string_split(p, '/')[2] as int), 1) = 0)), false)"


_dom, _dow = _hit(3, "day(dt)", 1, 31), f"({_hit(5, 'dayofweek(dt)', 0, 7)} or (dayofweek(dt) = 0 and {_hit(5, '7', 0, 7)}))"
FIRES = f"""given as (select robot_id, trim(regexp_replace({pick_sql('robot_id', *CRONS)}, '\\s+', ' ', 'g')) as cron from robots),
    fit as (select cron, dt, row_number() over (partition by cron order by dt) as k from (select distinct cron from given where len(string_split(cron, ' ')) = 5), (select unnest(range(epoch_ms({NOW_MS})::date::timestamp, epoch_ms({NOW_MS})::date::timestamp + interval 2929 day, interval 1 day)) as dt)
        where {_hit(4, 'month(dt)', 1, 12)} and case when starts_with(string_split(cron, ' ')[3], '*') or starts_with(string_split(cron, ' ')[5], '*') then {_dom} and {_dow} else {_dom} or {_dow} end),
    fire as (select cron, epoch_ms(dt) + t * 60000 as fire_ms, row_number() over (partition by cron order by dt, t) as k from (select * from fit where k <= 3), (select unnest(range(1440)) as t)
        where epoch_ms(dt) + t * 60000 > {NOW_MS} and {_hit(2, '(t // 60)', 0, 23)} and {_hit(1, '(t % 60)', 0, 59)}),
    two as (select cron, max(fire_ms) filter (where k = 1) as one, max(fire_ms) filter (where k = 2) as other from fire group by cron)"""


def fires(spark, d):
    """robot_id, fires: each expression is expanded once, not for every robot that has it."""
    given = robots(spark, d).select("robot_id", pick(F.col("robot_id"), *CRONS).alias("cron"))
    return given.join(given.select("cron").distinct().withColumn("fires", C.cron_fires(F.col("cron"), NOW_MS)), "cron", "left")


@query(f"with {FIRES} select robot_id, one as next_ms from given left join two using (cron)", "robots")
def dt_cron_next(spark, d):
    """The next fire after now in UTC; null if the expression is not valid or never fires."""
    return fires(spark, d).select("robot_id", F.get("fires", F.lit(0)).alias("next_ms"))


@query(f"with {FIRES} select robot_id, coalesce(other - one >= {LEAST_GAP}, false) as ok from given left join two using (cron)", "robots")
def dt_cron_validate(spark, d):
    """Whether the next two fires lie at least a quarter of an hour apart."""
    return fires(spark, d).select("robot_id", F.coalesce(F.get("fires", F.lit(1)) - F.get("fires", F.lit(0)) >= LEAST_GAP, F.lit(False)).alias("ok"))
