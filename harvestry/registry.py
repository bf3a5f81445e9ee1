"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", name: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under its name; `views` names the logical views that its SQL needs."""

    def put(f):
        from harvestry.plans.views import VIEW_SQL

        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            parts = [f"{v} as ({VIEW_SQL[v]})" for v in views.split()]
            text = sql.strip()
            if parts and text.lower().startswith("with recursive"):
                text = "with recursive " + ", ".join(parts) + ", " + text[len("with recursive") :]
            elif parts and text.lower().startswith("with "):
                text = "with " + ", ".join(parts) + ", " + text[5:]
            elif parts:
                text = "with " + ", ".join(parts) + " " + text
            SQL[key] = text
        return f

    return put
