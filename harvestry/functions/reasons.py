"""Failure reasons from error texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of each reason in a lower-cased error text, in order of precedence.
REASONS = (
    ("captcha", "captcha"),
    ("browser_closed", "browser has been closed|target closed|session closed"),
    ("circuit_open", "circuit open|host circuit"),
    ("timeout", "timeout|timed out|exceeded"),
    ("navigation_error", "page[.]goto|net::err|navigation|err_name_not_resolved|err_connection"),
    ("layout_change", "zero rows|layout|selector"),
)
CODES = tuple(code for code, _ in REASONS) + ("unknown",)


def failure_reason(message: Column) -> Column:
    """Code of the first reason whose mark the text has, `unknown` if none, null for a blank text."""
    low = F.lower(message)
    found = F.when(F.coalesce(F.trim(message), F.lit("")) == "", None)
    for code, marks in REASONS:
        hit = low.rlike(marks)
        if code == "browser_closed":
            hit = hit | (low.contains("browsercontext") & low.contains("closed"))
        found = found.when(hit, code)
    return found.otherwise("unknown")


def reason_sql(column: str) -> str:
    low = f"lower({column})"
    cases = [f"when regexp_matches({low}, '{marks}')" + (f" or (contains({low}, 'browsercontext') and contains({low}, 'closed'))" if code == "browser_closed" else "") + f" then '{code}'" for code, marks in REASONS]
    return f"case when trim(coalesce({column}, '')) = '' then null {' '.join(cases)} else 'unknown' end"
