"""Cleaners of scraped text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named references that are decoded, in order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nz(c: Column) -> Column:
    """Null for blank text."""
    return F.nullif(F.trim(c), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _reference(prefix: str, base: int):
    """Replaces one numeric reference in a text by its character."""

    def put(text: Column, number: Column) -> Column:
        code = F.conv(number, base, 10).cast("decimal(20,0)")
        sign = F.decode(F.unhex(F.lpad(F.hex(code.cast("int")), 8, "0")), "UTF-32")
        known = (F.length(number) <= 9) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.replace(text, F.concat(F.lit(prefix), number, F.lit(";")), F.when(known, sign).otherwise(""))

    return put


def decode_entities(c: Column, one_line: bool = True) -> Column:
    """Named references whatever their case, then hexadecimal and decimal ones; a number that names no character gives nothing."""

    def decoded(text: Column) -> Column:
        for name, sign in ENTITIES:
            text = F.regexp_replace(text, F.lit(f"(?i){name}"), F.lit(sign))
        for prefix, digits, base in (("&#x", "[0-9a-fA-F]+", 16), ("&#", "[0-9]+", 10)):
            found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"{prefix}({digits});"), F.lit(1)))  # noqa: B023, E731
            text = let(text, lambda t: F.aggregate(found(t), t, _reference(prefix, base)))  # noqa: B023
        return text

    c = let(c, lambda text: F.when(text.contains("&"), decoded(text)).otherwise(text))
    return collapse(c) if one_line else F.trim(c)


def entities_sql(column: str) -> str:
    """The same for numbers of few digits, as texts of pages have them."""
    quoted = lambda x: x.replace("'", "''")
    for name, sign in ENTITIES:
        column = f"regexp_replace({column}, '(?i){name}', '{quoted(sign)}', 'g')"
    for prefix, digits, number in (("&#x", "[0-9a-fA-F]+", "('0x' || x)::int"), ("&#", "[0-9]+", "x::int")):
        v = f"v{len(digits)}"
        column = f"(select list_reduce(list_prepend({v}, list_distinct(regexp_extract_all({v}, '{prefix}({digits});', 1))), lambda a, x: replace(a, '{prefix}' || x || ';', chr({number}))) from (select {column} as {v}))"
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def strip_html(c: Column) -> Column:
    """Scripts and styles go, breaks and block ends are line feeds, list items bullets, other tags spaces."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?i)<li[^>]*>", "\n• ")
    c = F.regexp_replace(c, r"(?i)<br ?/?>|</(p|div|h[1-6]|li|ul|ol|tr)>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(c, r" ?\n[ \n]*", "\n"))


def snippet(c: Column, most: int = 280) -> Column:
    one = collapse(c)
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…"))).otherwise(one)


def strip_sql(column: str) -> str:
    c = f"regexp_replace({column}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i)<li[^>]*>', chr(10) || '• ', 'g')"
    c = f"regexp_replace({c}, '(?i)<br ?/?>|</(p|div|h[1-6]|li|ul|ol|tr)>', chr(10), 'g')"
    c = f"regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g')"
    return f"trim(regexp_replace({c}, ' ?\\n[ \\n]*', chr(10), 'g'))"
