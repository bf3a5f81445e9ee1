"""Descriptions cut into titled sections: lines that are headings, what follows each, and the lines of a section as bullets or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.cleaners import let
from harvestry.plans.views import table
from harvestry.registry import query

#: Titles of sections, in lower case; how such titles begin; words that make a short capitalised line one; and titles that also stand within a line.
TITLES = (
    "about", "about the job", "about the role", "about the team", "about the company", "about the opportunity", "job responsibilities", "job description", "job summary", "job overview", "key responsibilities", "responsibilities",
    "required qualifications", "required skills", "required experience", "preferred qualifications", "preferred skills", "preferred experience", "minimum qualifications", "basic qualifications", "qualifications", "requirements", "skills", "benefits", "what we offer",
    "what you'll do", "what you'll get", "what you'll bring", "what you will do", "what you will get", "what you will bring", "who you are", "you will", "our team", "equal opportunity", "equal opportunity employer", "eeo", "compensation", "compensation and benefits",
    "how to apply", "application process", "additional information", "working here", "working with us", "why join", "why us", "role overview", "position summary", "essential functions", "duties", "duties and responsibilities",
)
BEGINS = r"^(?:(?:required|preferred|minimum|basic) qualifications|(?:job )?(?:key )?responsibilities|about the (?:job|role))\b"
TELLING = ("qualification", "requirement", "benefit", "skill", "overview", "summary", "description", "compensation", "opportunity")
SMALL = ("and", "or", "of", "the", "a", "an", "for", "to", "in", "with")
INLINE = (
    "required qualifications, capabilities, and skills", "preferred qualifications, capabilities, and skills", "compensation and benefits", "duties and responsibilities", "preferred qualifications", "required qualifications", "minimum qualifications",
    "basic qualifications", "key responsibilities", "essential functions", "job responsibilities", "equal opportunity", "what you will do", "what you'll bring", "position summary", "role overview", "responsibilities", "what you'll do", "what we offer", "about the role", "about the job", "benefits", "about us", "skills",
)
ALONE = ("qualifications", "requirements")
#: Characters of a heading, of a paragraph that has no line of its own, and of a text that is cut into such.
HEADING, PARAGRAPH, LONG = 90, 320, 500


def _any(labels) -> str:
    return "|".join(x.replace(" ", r"\s+") for x in labels)


#: A title at a line's beginning, after a sentence or bullet, or before a bullet goes on a line of its own.
AT_START, WITHIN, BEFORE_BULLET = rf"(?i)(^|\n)\s*({_any(INLINE + ALONE)})\s*:?\s*(\n|•|[A-Z])", rf"(?i)([.!?•])\s+({_any(INLINE)})\s*:?\s*([•A-Z\n])", rf"(?i)([a-z0-9)])\s+({_any(INLINE)})\s*(•)"


def prepared(text: Column) -> Column:
    for pattern in (AT_START, WITHIN, BEFORE_BULLET):
        text = F.regexp_replace(text, pattern, "$1\n\n$2\n$3")
    return F.regexp_replace(F.regexp_replace(text, "•", "\n• "), r"\n{3,}", "\n\n")


def bare(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r"[:\-–—\s]+$", "")


def is_heading(line: Column) -> Column:
    """A known title, one that begins like one, capitals only, or a short capitalised line with a telling word; no bullets and no long sentences."""

    def told(t: Column) -> Column:
        low, letters, ends = F.regexp_replace(F.lower(F.replace(t, F.lit("’"), F.lit("'"))), r"\s+", " "), F.regexp_replace(t, "[^A-Za-z]", ""), t.rlike("[.!?]$")
        words = F.split(t, r"\s+")
        short = (F.length(t) <= 48) & t.rlike(r"^[A-Z][A-Za-z0-9/&'’\-\s]+$") & (F.size(words) <= 6) & F.forall(words, lambda w: w.rlike("^[A-Z0-9]") | F.lower(w).isin(*SMALL))
        telling = F.exists(F.split(F.lower(t), "[^a-z0-9_]+"), lambda w: w.isin(*TELLING))
        sized = F.length(t).between(3, HEADING) & ~t.rlike(r"^[•\-*]") & ~(ends & (F.length(t) > 40))
        return sized & (low.isin(*TITLES) | low.rlike(BEGINS) | ((F.length(letters) >= 4) & (letters == F.upper(letters)) & ~ends) | (short & ~ends & telling))

    return let(bare(line), told)


def tidy(lines: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def paragraphs(body: Column) -> Column:
    """Sentences put together to paragraphs of up to PARAGRAPH characters."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s, x):
        longer = F.trim(F.concat(s["open"], x))
        full = (F.length(longer) > PARAGRAPH) & (s["open"] != "")
        return F.struct(F.when(full, x).otherwise(longer).alias("open"), F.when(full, F.array_append(s["done"], F.trim(s["open"]))).otherwise(s["done"]).alias("done"))

    return let(F.aggregate(F.regexp_extract_all(body, F.lit(r"[^.!?]+[.!?]+|[^.!?]+$"), F.lit(0)), start, step), lambda s: F.array_join(F.when(F.trim(s["open"]) != "", F.array_append(s["done"], F.trim(s["open"]))).otherwise(s["done"]), "\n\n"))


def sections(rows: DataFrame) -> DataFrame:
    """rows: id, text -> id, position, slug, title, body, cut of the sections that have a body. What comes before the first heading, or has none at all, is the description; a long one of a single line is `cut` into paragraphs, headings alone are a description. Blank text has no sections."""
    lines = F.transform(F.split(F.regexp_replace(prepared(F.replace("text", F.lit("\r\n"), F.lit("\n"))), r"^\s+|\s+$", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    x = rows.select("id", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("text")).where("text <> ''").select("id", "text", lines.alias("lines"))
    marks = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: is_heading(F.get("lines", i)))
    x = x.select("id", "text", "lines", F.concat(F.array(F.lit(-1)), marks).alias("at"))
    part = lambda i, k: F.struct(F.when(i < 0, "Description").otherwise(bare(F.get("lines", i))).alias("title"), tidy(F.slice("lines", i + 2, F.coalesce(F.get("at", k + 1), F.size("lines")) - i - 1)).alias("body"))
    x = x.select("id", "text", F.size("at").alias("n"), F.transform("at", part).alias("parts"))
    # The first part is counted even if it is empty, later ones only if they are not.
    before = lambda k: F.when(k == 0, 0).otherwise(1 + F.size(F.filter(F.slice("parts", F.lit(2), k - 1), lambda p: p["body"] != "")))
    numbered = F.transform("parts", lambda p, k: F.struct(p["title"].alias("title"), p["body"].alias("body"), before(F.when(k > 0, k).otherwise(1)).alias("nth"), k.alias("k")))
    one_line = (F.col("n") == 1) & (F.length("body") > LONG) & ~F.col("body").contains("\n")
    whole = F.array(F.struct(F.lit("Description").alias("title"), tidy(F.array("text")).alias("body"), F.lit(0).alias("nth"), F.lit(0).alias("k")))  # headings alone
    x = x.select("id", "n", F.posexplode(let(F.filter(numbered, lambda p: p["body"] != ""), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))).alias("position", "p")).select("id", "n", "position", "p.*")
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 40)
    nth = F.when(F.col("k") == 0, 0).otherwise(F.col("nth"))
    return x.select("id", "position", F.concat(F.coalesce(F.nullif(slug, F.lit("")), F.lit("section")), F.lit("-"), nth.cast("string")).alias("slug"), "title", F.when(one_line, paragraphs(F.col("body"))).otherwise(F.col("body")).alias("body"), one_line.alias("cut"))


def lines_of(body: Column) -> Column:
    """The lines of a section: type (bullet or text) and text."""
    each = F.filter(F.transform(F.split(body, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(each, lambda x: F.struct(F.when(x.rlike(r"^[•\-*]"), "bullet").otherwise("text").alias("type"), F.regexp_replace(x, r"^[•\-*]\s*", "").alias("text")))


# Queries: documents with headings of all kinds put before every fourth of their lines


#: What is put before some of a document's lines, by the line's number and the document's.
HEADS = ("Responsibilities:\n", "", "WHAT WE OFFER\n", "Required qualifications, capabilities, and skills ", "• ", "Team Benefit Overview\n", "About the role - \n", "Skills: ")
_marked = "array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case when i % 4 = 2 then [" + ", ".join("'" + h.replace("\n", "' || chr(10) || '") + "'" for h in HEADS) + f"][(doc_id + i // 4) % {len(HEADS)} + 1] || x else x end), chr(10))"


def marked(spark, d) -> DataFrame:
    put = F.array(*map(F.lit, HEADS))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when((i + 1) % 4 == 2, F.concat(F.get(put, ((F.col("doc_id") + F.floor((i + 1) / 4)) % len(HEADS)).cast("int")), x)).otherwise(x))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(lines, "\n").alias("text"))


_trim = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_q = lambda p: p.replace("'", "''")
_prep = _marked
for _p in (AT_START, WITHIN, BEFORE_BULLET):
    _prep = f"regexp_replace({_prep}, '{_q(_p)}', '\\1' || chr(10) || chr(10) || '\\2' || chr(10) || '\\3', 'g')"
_texts = lambda xs: "[" + ", ".join(f"'{_q(x)}'" for x in xs) + "]"
_ends = "regexp_matches(t, '[.!?]$')"
_letters = "regexp_replace(t, '[^A-Za-z]', '', 'g')"
_words = "string_split_regex(t, '\\s+')"
CUT = f"""said as (select doc_id as id, {_trim(_marked)} <> '' as filled, {_trim(f"regexp_replace(replace({_prep}, '•', chr(10) || '• '), '\\n{{3,}}', chr(10) || chr(10), 'g')")} as text from documents),
lines as (select id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as i from said where filled),
bare as (select id, i, {_trim('raw')} as x, regexp_replace({_trim('raw')}, '[:–—\\s-]+$', '') as t from lines),
heads as (select *, length(t) between 3 and {HEADING} and not regexp_matches(t, '^[•*-]') and not ({_ends} and length(t) > 40) and (
    list_contains({_texts(TITLES)}, regexp_replace(lower(replace(t, '’', '''')), '\\s+', ' ', 'g')) or regexp_matches(regexp_replace(lower(t), '\\s+', ' ', 'g'), '{BEGINS}') or (length({_letters}) >= 4 and {_letters} = upper({_letters}) and not {_ends})
    or (length(t) <= 48 and not {_ends} and regexp_matches(t, '^[A-Z][A-Za-z0-9/&''’\\s-]+$') and len({_words}) <= 6 and len(list_filter({_words}, lambda w: not regexp_matches(w, '^[A-Z0-9]') and not list_contains({_texts(SMALL)}, lower(w)))) = 0 and list_has_any(string_split_regex(lower(t), '[^a-z0-9_]+'), {_texts(TELLING)}))) as head from bare),
parts as (select *, count(*) filter (head) over (partition by id order by i) as k from heads),
bodies as (select id, k, coalesce(any_value(t) filter (head), 'Description') as title, coalesce({_trim("regexp_replace(string_agg(x, chr(10) order by i) filter (not head), '\\n{3,}', chr(10) || chr(10), 'g')")}, '') as body from parts group by id, k),
held as (select *, case when k = 0 then 0 else 1 + coalesce(sum((k > 0 and body <> '')::int) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0) end as nth, max(k) over (partition by id) as last from bodies),
kept as (select id, k, title, body, nth, last, row_number() over (partition by id order by k) - 1 as position from held where body <> ''
  union all select doc_id, 0, 'Description', {_trim(_marked)}, 0, 1, 0 from documents where {_trim(_marked)} <> '' and doc_id not in (select id from held where body <> ''))"""


@query(f"with {CUT} select id as doc_id, position, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[:40], ''), 'section') || '-' || nth as slug, title, md5(regexp_replace(case when last = 0 and length(body) > {LONG} and not contains(body, chr(10)) then regexp_replace(body, '^[.!?]+', '') else body end, '\\s+', '', 'g')) as letters_md5 from kept")
def fn_sections(spark, d):
    """The sections of all documents, with a digest of their letters; how lines are broken is in `fn_section_lines`."""
    return sections(marked(spark, d)).select(F.col("id").alias("doc_id"), "position", "slug", "title", F.md5(F.regexp_replace("body", r"\s+", "")).alias("letters_md5"))


@query(f"with {CUT}, l as (select id, position, unnest(string_split_regex(body, '\\n+')) as x from kept where not (last = 0 and length(body) > {LONG} and not contains(body, chr(10)))) select id as doc_id, position, count(*) filter (regexp_matches(trim(x), '^[•*-]')) as bullets, count(*) filter (not regexp_matches(trim(x), '^[•*-]')) as texts from l where trim(x) <> '' group by id, position")
def fn_section_lines(spark, d):
    """Bullets and lines of text of each section, but of texts of one long line, whose lines are the paragraphs that they are cut into."""
    x = sections(marked(spark, d)).where("not cut").select(F.col("id").alias("doc_id"), "position", lines_of(F.col("body")).alias("lines"))
    return x.select("doc_id", "position", F.size(F.filter("lines", lambda x: x["type"] == "bullet")).cast("long").alias("bullets"), F.size(F.filter("lines", lambda x: x["type"] == "text")).cast("long").alias("texts"))
