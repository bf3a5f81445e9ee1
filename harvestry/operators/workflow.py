"""Workflow documents: conditions compiled to predicates, parameters bound, documents checked.

A condition is JSON: `url`, `cookies` and `selectors` of a page's state, `$before` and `$after` over the actions so far, and
`$and`, `$or`, `$not`. It becomes one Column; a plain URL reaches the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.plans.views import table
from harvestry.registry import query

LOGIC, META = ("$and", "$or", "$not"), ("$before", "$after")


def text_test(value, held: Column) -> Column:
    """Equal to a text, or found by a {"$regex": ...}; null and blank are neither."""
    if isinstance(value, dict) and set(value) == {"$regex"}:
        return F.coalesce((held != "") & F.regexp(held, F.lit(value["$regex"])), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((held == value) & (held != ""), F.lit(False))
    raise ValueError(f"neither a text nor a $regex: {value!r}")


def some(actions: str, value) -> Column:
    return F.coalesce(F.exists(actions, lambda a: text_test(value, a)), F.lit(False))


def every(tests) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def condition(where: dict, url: str = "url", cookies: str = "cookies", selectors: str = "selectors", used: str | None = "used") -> Column:
    """The predicate of a condition over columns: a text, a map of texts, and two lists of texts. All keys must hold.

    A page has one of the `selectors` named, or none are named and it has none; each cookie named must be there. `$before`: no action so
    far is the one named, `$after`: one is. Inside a logical operator no action counts as done, as there each part is looked at by itself.
    """
    tests = []
    for key, value in where.items():
        if key in LOGIC:
            parts = value if isinstance(value, list) else [{k: v} for k, v in value.items()]
            inner = [condition(p, url, cookies, selectors, None) for p in parts]
            if key == "$and":
                tests.append(every(inner))
            elif key == "$or":
                tests.append(reduce(lambda a, b: a | b, inner, F.lit(False)))
            else:
                tests.append(~condition(value, url, cookies, selectors, None))
        elif key in META:
            done = F.lit(False) if used is None else some(used, value)
            tests.append(done if key == "$after" else ~done)
        elif key == "url":
            tests.append(text_test(value, F.col(url)))
        elif key == "cookies":
            tests += [F.col(cookies).isNotNull(), *[text_test(v, F.try_element_at(cookies, F.lit(name))) for name, v in value.items()]]
        elif key == "selectors":
            named = F.array(*map(F.lit, value)).cast("array<string>")
            tests.append(F.coalesce(F.arrays_overlap(named, selectors) if value else F.size(selectors) == 0, F.lit(False)))
        elif key.startswith("$"):
            raise ValueError(f"undefined operator {key}")
        else:
            raise ValueError(f"no part of a page's state: {key}")
    return F.coalesce(every(tests), F.lit(False))


def selected(rows: DataFrame, where: dict, url: str = "url", **columns) -> DataFrame:
    """The rows for which a condition holds; a URL given as text is asked for plainly, so that the scan can skip what has another."""
    plain = where.get("url")
    return (rows.where(F.col(url) == plain) if isinstance(plain, str) else rows).where(condition(where, url, **columns))


def parameters(part) -> list[str]:
    """The names of a workflow's {"$param": name} places, in order, repeated if they are."""
    if isinstance(part, dict):
        return [part["$param"]] if part.get("$param") else [n for v in part.values() for n in parameters(v)]
    return [n for v in part for n in parameters(v)] if isinstance(part, list) else []


def bound(part, given: dict):
    """A workflow with its parameters put in; the names given must be just those that it has."""
    if sorted(given) != sorted(parameters(part)):
        raise ValueError(f"parameters {sorted(given)} are not those of the workflow: {sorted(parameters(part))}")

    def put(x):
        if isinstance(x, dict):
            return given[x["$param"]] if set(x) == {"$param"} else {k: put(v) for k, v in x.items()}
        return [put(v) for v in x] if isinstance(x, list) else x

    return put(part)


#: A workflow's shape. Parts that are lists have rows of what they hold; what is not named is an error.
STEP = "id string, where string, what array<struct<action: string, args: array<string>, name: string, actionId: string>>"
FILE_KEYS, META_KEYS, STEP_KEYS, WHAT_KEYS = ("meta", "workflow"), ("name", "desc"), ("id", "where", "what"), ("action", "args", "name", "actionId")
WHERE_KEYS = ("url", "selectors", "cookies", "$after", "$before", "$and", "$or", "$not")


def faults(document: Column) -> Column:
    """What is wrong with a workflow document (JSON text): the first fault of each kind; an empty list if it is right.

    Conditions are looked into two levels deep: what is nested deeper is refused when the condition is compiled.
    """
    v = F.try_parse_json(document)
    keys = lambda text: F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    odd = lambda text, known: F.exists(keys(text), lambda k: ~k.isin(*known))
    steps = F.from_json(F.get_json_object(document, "$.workflow"), "array<string>")
    whats = lambda s: F.coalesce(F.from_json(F.get_json_object(s, "$.what"), "array<string>"), F.array().cast("array<string>"))
    where = lambda s: F.get_json_object(s, "$.where")
    parts = lambda w, path: F.coalesce(F.from_json(F.get_json_object(w, path), "array<string>"), F.array().cast("array<string>"))
    nested = lambda w: F.concat(parts(w, "$['$and']"), parts(w, "$['$or']"))
    checks = [
        ("not JSON", v.isNull()),
        ("unknown key", odd(document, FILE_KEYS) | odd(F.get_json_object(document, "$.meta"), META_KEYS)),
        ("no workflow", v.isNotNull() & steps.isNull()),
        ("unknown key in a step", F.exists(steps, lambda s: odd(s, STEP_KEYS))),
        ("no where", F.exists(steps, lambda s: where(s).isNull())),
        ("unknown condition", F.exists(steps, lambda s: odd(where(s), WHERE_KEYS) | F.exists(nested(where(s)), lambda w: odd(w, WHERE_KEYS)))),
        ("no what", F.exists(steps, lambda s: F.get_json_object(s, "$.what").isNull())),
        ("no action", F.exists(steps, lambda s: F.exists(whats(s), lambda w: F.get_json_object(w, "$.action").isNull()))),
        ("unknown key in an action", F.exists(steps, lambda s: F.exists(whats(s), lambda w: odd(w, WHAT_KEYS)))),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())


# Queries


#: Conditions as a recorder writes them, over pages: their URL, the pairs of its query as cookies, the tags of the page as selectors, and the names in its menu as actions so far.
CONDITIONS = {
    "listing": {"url": {"$regex": "/(en|de)/[0-9]+"}, "selectors": ["article", "table"]},
    "paged": {"cookies": {"page": {"$regex": "^[0-9]+$"}}, "$not": {"cookies": {"ref": "x"}}},
    "either": {"$or": [{"url": {"$regex": "example[.]net"}}, {"$and": [{"selectors": ["footer"]}, {"cookies": {"page": "2"}}]}]},
    "after": {"$after": {"$regex": "^th"}, "$before": "of"},
    "never": {"selectors": ["marquee"]},
    "nested": {"$not": {"$or": [{"$after": "the"}, {"url": {"$regex": "/fr/"}}]}, "selectors": ["nav"]},
}
STATE = """state as (select page_id, url, regexp_extract_all(url, '[?&]([^=&#]+)=([^&#]*)', 1) as names, regexp_extract_all(url, '[?&]([^=&#]+)=([^&#]*)', 2) as vals,
  list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as tags, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) as done from pages),
s as (select *, vals[list_position(names, 'page')] as page, vals[list_position(names, 'ref')] as ref from state)"""


@query(f"""with {STATE} select page_id, 'listing' as condition, regexp_matches(url, '/(en|de)/[0-9]+') and list_has_any(tags, ['article', 'table']) as holds from s
union all select page_id, 'paged', coalesce(regexp_matches(page, '^[0-9]+$'), false) and not coalesce(ref = 'x', false) from s
union all select page_id, 'either', contains(url, 'example.net') or (list_contains(tags, 'footer') and coalesce(page = '2', false)) from s
union all select page_id, 'after', len(list_filter(done, lambda x: starts_with(x, 'th'))) > 0 and not list_contains(done, 'of') from s
union all select page_id, 'never', list_contains(tags, 'marquee') from s
union all select page_id, 'nested', not contains(url, '/fr/') and list_contains(tags, 'nav') from s""")
def wf_predicate(spark, d):
    """Whether each of six recorded conditions holds on each page."""
    names, values = (F.regexp_extract_all("url", F.lit("[?&]([^=&#]+)=([^&#]*)"), F.lit(k)) for k in (1, 2))
    pages = table(spark, d, "pages").select("page_id", "url", F.map_from_arrays(names, values).alias("cookies"), F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("selectors"), F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1)).alias("used"))
    return pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(name).alias("condition"), condition(where).alias("holds")) for name, where in CONDITIONS.items()])).alias("x")).select("page_id", "x.condition", "x.holds")


@query("select page_id, url from pages where contains(url, '/en/') and regexp_matches(url, 'page=[0-9]')")
def udf_where_dsl(spark, d):
    """Pages that a condition with parameters selects, once these are bound."""
    where = {"url": {"$param": "place"}, "$and": [{"url": {"$regex": {"$param": "pattern"}}}]}
    found = bound(where, {"place": {"$regex": "/en/"}, "pattern": "page=[0-9]"})
    return selected(table(spark, d, "pages"), found, used=None).select("page_id", "url")


@query("select event_id as run_id, case event_id % 4 when 0 then ['limit', 'url'] when 1 then ['url'] when 2 then [] else ['url', 'url'] end as names, case when event_id % 4 = 1 then user_id::varchar end as bound_url from events")
def wf_params(spark, d):
    """The parameters of each run's workflow, repeated ones too, and the URL once a workflow with one is bound to the run's robot."""
    place = lambda name: F.concat(F.lit('{"$param":"'), F.lit(name), F.lit('"}'))
    k = F.col("event_id") % 4
    step = F.when(k == 0, F.concat(F.lit('[{"where":{"url":'), place("limit"), F.lit('},"what":[{"action":"goto","args":['), place("url"), F.lit("]}]}]"))).when(k == 1, F.concat(F.lit('[{"where":{},"what":[{"action":"goto","args":['), place("url"), F.lit("]}]}]"))).when(k == 2, F.lit('[{"where":{},"what":[]}]')).otherwise(F.concat(F.lit('[{"where":{"url":'), place("url"), F.lit('},"what":[{"action":"goto","args":['), place("url"), F.lit("]}]}]")))
    names = F.regexp_extract_all(step, F.lit(r'\{"\$param":"([^"]+)"\}'), F.lit(1))
    whole = F.replace(step, place("url"), F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')))
    url = F.when((F.size(names) == 1) & F.array_contains(names, "url"), F.get_json_object(whole, "$[0].what[0].args[0]"))
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), names.alias("names"), url.alias("bound_url"))


@query("select event_id as run_id, case event_id % 6 when 0 then ['not JSON'] when 1 then [] when 2 then ['no workflow'] when 3 then ['no where', 'no action'] when 4 then ['unknown condition'] else ['unknown key', 'unknown key in an action'] end as faults from events")
def wf_validate(spark, d):
    """What is wrong with each run's workflow document."""
    k = F.col("event_id") % 6
    robot = F.col("user_id").cast("string")
    document = F.when(k == 0, F.concat(F.lit("{"), robot)).when(k == 1, F.concat(F.lit('{"meta":{"name":"'), robot, F.lit('"},"workflow":[{"where":{"url":"http://a"},"what":[{"action":"goto"}]}]}'))).when(k == 2, F.concat(F.lit('{"meta":{"name":"'), robot, F.lit('"}}')))
    document = document.when(k == 3, F.lit('{"workflow":[{"what":[{"name":"x"}]}]}')).when(k == 4, F.lit('{"workflow":[{"where":{"$and":[{"uri":"x"}]},"what":[]}]}')).otherwise(F.lit('{"extra":1,"workflow":[{"where":{},"what":[{"action":"a","arg":[]}]}]}'))
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), faults(document).alias("faults"))

