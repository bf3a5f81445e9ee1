"""The first text under any of some keys, anywhere in a JSON document, level by level in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.plans.views import listings
from harvestry.registry import query

#: Levels looked into below the document's own, and items of a list.
DEPTH, ITEMS = 6, 40


def level(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows: id, way, json -> the matches among an object's own texts (id, way, value), and the objects and lists within (id, way, json).

    Each level is read twice: as raw texts, which keep the order of keys below, and as variants, which tell texts from what only looks like them.
    """
    listed = F.ltrim(F.col("json")).startswith("[")
    raw = F.when(~listed, F.map_entries(F.from_json("json", "map<string,string>")))
    kind = F.when(~listed, F.map_entries(F.transform_values(F.from_json("json", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))))
    own = F.arrays_zip(raw.alias("raw"), kind.alias("kind"))
    items = F.slice(F.arrays_zip(F.from_json("json", "array<string>").alias("raw"), F.transform(F.from_json("json", "array<variant>"), lambda v: F.schema_of_variant(v)).alias("kind")), 1, ITEMS)
    read = rows.select("id", "way", own.alias("own"), F.when(listed, items).alias("items"))
    wanted = F.array(*[F.lit(k.lower()) for k in keys])
    texts = F.filter("own", lambda x: F.array_contains(wanted, F.lower(x["raw"]["key"])) & (x["kind"]["value"] == "STRING") & (F.trim(x["raw"]["value"]) != ""))
    # An object's own texts come before all that lies below it.
    found = read.select("id", F.concat("way", F.array(F.lit(-1))).alias("way"), F.trim(F.get(texts, F.lit(0))["raw"]["value"]).alias("value")).where("value is not null")
    nested = lambda k: k.startswith("OBJECT") | k.startswith("ARRAY")
    inner = F.concat(
        F.coalesce(F.transform("own", lambda x, i: F.struct(i.alias("at"), x["raw"]["value"].alias("json"), x["kind"]["value"].alias("kind"))), F.array().cast("array<struct<at:int,json:string,kind:string>>")),
        F.coalesce(F.transform("items", lambda x, i: F.struct(i.alias("at"), x["raw"].alias("json"), x["kind"].alias("kind"))), F.array().cast("array<struct<at:int,json:string,kind:string>>")),
    )
    below = read.select("id", "way", F.explode(F.filter(inner, lambda x: nested(x["kind"]))).alias("x"))
    return found, below.select("id", F.concat("way", F.array("x.at")).alias("way"), "x.json")


def deep_find(rows: DataFrame, json: Column, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """rows: id -> id, value: the first text that is not blank under one of `keys`, whatever their case; null if there is none.

    An object's own keys are asked first, in their order, then what lies in it, in its order, down to `depth` levels below the document and
    the first ITEMS of a list. Text that is no JSON, a bare value, and null have no match.
    """
    here = rows.select("id", F.array().cast("array<int>").alias("way"), json.alias("json")).where(F.try_parse_json("json").isNotNull() & F.ltrim("json").rlike("^[{\\[]"))
    every = None
    for d in range(depth + 1):
        found, here = level(here, keys)
        every = found if every is None else every.unionByName(found)
        if d == depth:
            break
    first = every.groupBy("id").agg(F.min_by("value", "way").alias("value"))
    return rows.select("id").join(first, "id", "left")


KEYS = ["widgetKey", "RefNum", "apiKey"]
#: Documents of all depths around a listing's title: objects, lists, decoys that are no text, and one beyond the last level.
SHAPES = (
    ('{"a":1,"RefNum":', "}"), ('{"x":{"y":[1,{"apikey":', '}]},"refnum":7}'), ('{"z":{"widgetKey":"  "},"b":{"c":{"widgetkey":', '}},"widgetKey":{"a":1}}'), ("[[],[{\"refNum\":", "}]]"),
    ('{"p":{"q":{"r":{"s":{"t":{"u":{"apiKey":', "}}}}}}}"), ('{"p":{"q":{"r":{"s":{"t":{"u":{"v":{"apiKey":', "}}}}}}}}"), ('{"b":{"refNum":"below"},"a":[{"x":1}],"REFNUM":', "}"), ("{broken", ""), ('"refNum"', ""),
)


def _document_sql() -> str:
    cases = " ".join(f"when {i} then '{a}' || coalesce(to_json(title)::varchar, '') || '{b}'" if b else f"when {i} then '{a}'" for i, (a, b) in enumerate(SHAPES))
    return f"case page_id % {len(SHAPES)} {cases} end"


@query(f"""with docs as (select page_id, {_document_sql()} as j from listings),
tree as (select page_id, t.* from (select page_id, j from docs where json_valid(j)) d, json_tree(d.j) t),
found as (select t.page_id, arg_min(trim(t.atom ->> '$'), (t.parent, t.id)) as value from tree t
  where t.type = 'VARCHAR' and lower(t.key) in ('widgetkey', 'refnum', 'apikey') and trim(t.atom ->> '$') <> '' and len(regexp_extract_all(t.path, '[.\\[]')) <= {DEPTH} group by t.page_id)
select page_id, value from docs left join found using (page_id)""", "listings")
def js_deep_find(spark, d):
    """A provider's key, wherever its page's data have it."""
    title = F.substring(F.to_json(F.array("title")), 2, 1 << 20)
    title = F.left(title, F.length(title) - 1)
    document = F.lit(None).cast("string")
    for i, (a, b) in enumerate(SHAPES):
        document = F.when(F.col("page_id") % len(SHAPES) == i, F.concat(F.lit(a), title, F.lit(b)) if b else F.lit(a)).otherwise(document)
    rows = listings(spark, d).select(F.col("page_id").alias("id"), "title", "page_id").withColumn("document", document)
    return deep_find(rows, F.col("document"), KEYS).withColumnRenamed("id", "page_id")
