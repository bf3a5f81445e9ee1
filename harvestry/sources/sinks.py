"""Sinks that write and are read back: run replacement, CSV, JSON, sheets, fan-out, back-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions.reasons import failure_reason, reason_sql
from harvestry.plans.views import listings, runs
from harvestry.registry import query
from harvestry.sources.storage import fresh_path


def replace_by(rows: DataFrame, path: str, key: str) -> None:
    """Write rows in place of those with the same keys: only the folders of those keys are overwritten, so that a repeated write changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(key).parquet(path)


@query("select run_id, day, case when day % 2 = 0 then rows_extracted + 1 else rows_extracted end as n from (select run_id, rows_extracted, at_ms // 86400000 as day from runs)", "runs")
def snk_replace_run(spark, d):
    """All days' rows are stored, then those of every second day come again, changed, twice: each day holds its last rows once."""
    path = fresh_path(spark, "sink-runs")
    rows = runs(spark, d).select("run_id", F.col("rows_extracted").alias("n"), F.floor(F.col("at_ms") / 86_400_000).alias("day"))
    replace_by(rows, path, "day")
    changed = rows.where("day % 2 = 0").withColumn("n", F.col("n") + 1)
    for _ in range(2):
        replace_by(changed, path, "day")
    return spark.read.schema(rows.schema).parquet(path).select("run_id", "day", "n")


def guarded(c: str) -> F.Column:
    """A cell that a spreadsheet does not take for a formula."""
    return F.when(F.col(c).rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)


CELL = "case when page_id % 5 = 0 then '''=' || title when page_id % 5 = 1 then title || '\"quoted\", ' else title end"


def cells(spark, d) -> DataFrame:
    title = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("="), "title")).when(F.col("page_id") % 5 == 1, F.concat("title", F.lit('"quoted", '))).otherwise(F.col("title"))
    return listings(spark, d).select(F.col("page_id").cast("string").alias("page_id"), title.alias("title"), "url")


@query(f"select page_id::varchar as page_id, {CELL} as title, url from listings", "listings")
def snk_csv(spark, d):
    """Header, every cell quoted, quotes doubled, formulas guarded; read back by the header."""
    path = fresh_path(spark, "sink-csv")
    form = {"header": "true", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows = cells(spark, d).select(*map(guarded, ("page_id", "title", "url")))
    rows.write.options(quoteAll="true", **form).csv(path)
    return spark.read.options(**form).schema(rows.schema).csv(path)


@query(f"select page_id::varchar as page_id, {CELL.replace(chr(39) * 3 + '=', chr(39) + '=')} as title, url from listings", "listings")
def snk_json(spark, d):
    """One object a row, as it is."""
    path = fresh_path(spark, "sink-json")
    rows = cells(spark, d)
    rows.write.option("compression", "gzip").json(path)
    return spark.read.schema(rows.schema).json(path)


@query(f"select page_id::varchar as page_id, {CELL} as title, n from listings cross join (select unnest([1, 2]) as n) where n = 1 or page_id % 2 = 0", "listings")
def snk_sheets(spark, d):
    """Rows appended by two runs under one header: later files have none of their own."""
    path = fresh_path(spark, "sink-sheet")
    rows = cells(spark, d).select(*map(guarded, ("page_id", "title")))
    form = {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.withColumn("n", F.lit(1)).write.options(quoteAll="true", **form).csv(path)
    rows.where("page_id % 2 = 0").withColumn("n", F.lit(2)).write.mode("append").options(quoteAll="true", **form).csv(path)
    return spark.read.options(**form).schema("page_id string, title string, n int").csv(path)


def fan_out(rows: DataFrame, sinks: dict) -> list[tuple[str, bool, str]]:
    """Hand rows to each sink in order; one that fails does not keep the others from theirs. (name, ok, error) of each."""
    done = []
    for name, write in sinks.items():
        try:
            write(rows)
            done.append((name, True, ""))
        except Exception as e:  # noqa: BLE001 - any sink may fail in its own way
            done.append((name, False, type(e).__name__))
    return done


@query("select * from (values ('csv', true, '', (select count(*) from listings)), ('database', false, 'ConnectionError', 0), ('json', true, '', (select count(*) from listings))) v(sink, ok, error, n_rows)", "listings")
def snk_fanout(spark, d):
    paths = {k: fresh_path(spark, f"sink-{k}") for k in ("csv", "json")}

    def refuse(_):
        raise ConnectionError("no database here")

    rows = cells(spark, d)
    done = fan_out(rows, {"csv": lambda r: r.write.option("quoteAll", "true").option("escape", '"').csv(paths["csv"]), "database": refuse, "json": lambda r: r.write.json(paths["json"])})
    stored = {"csv": spark.read.option("multiLine", "true").option("escape", '"').csv(paths["csv"]).count(), "json": spark.read.schema(rows.schema).json(paths["json"]).count()}
    return spark.createDataFrame([(*x, stored.get(x[0], 0)) for x in done], "sink string, ok boolean, error string, n_rows long")


@query("select run_id, 'rows' as table_name, '{\"n\":' || rows_extracted || ',\"added\":' || jobs_added || '}' as payload from runs where rows_extracted is not null and jobs_added is not null", "runs")
def snk_sql_db(spark, d):
    """The rows that a database would get, each as JSON beside its run; only a plain table name is accepted. Nothing is connected to here."""
    name = "rows"
    if not name.isidentifier():
        raise ValueError("not a plain table name")
    rows = runs(spark, d).where("rows_extracted is not null and jobs_added is not null")
    return rows.select("run_id", F.lit(name).alias("table_name"), F.to_json(F.struct(F.col("rows_extracted").alias("n"), F.col("jobs_added").alias("added"))).alias("payload"))


@query(f"select run_id, case when finished_at like '%Z' then finished_at else strftime(make_timestamp(started_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' end as sort_at, finished_at is not null and finished_at not like '%Z' as malformed, case when status = 'failed' then coalesce({reason_sql('error_message')}, 'unknown') end as reason from runs", "runs")
def snk_backfill(spark, d):
    """Fields that older rows lack, written to a table of their own: the time to sort by, whether the stored one is malformed, the reason."""
    path = fresh_path(spark, "sink-backfill")
    rows = runs(spark, d)
    iso = F.date_format(F.timestamp_millis("started_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    good = F.col("finished_at").endswith("Z")
    out = rows.select("run_id", F.when(good, F.col("finished_at")).otherwise(iso).alias("sort_at"), (F.col("finished_at").isNotNull() & ~F.coalesce(good, F.lit(False))).alias("malformed"), F.when(F.col("status") == "failed", F.coalesce(failure_reason(F.col("error_message")), F.lit("unknown"))).alias("reason"))
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
