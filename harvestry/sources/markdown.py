"""Pages as Markdown: headings with signs, links made absolute, lists, quotes, code and tables. Pages are parsed one by one in tasks, in bounded batches."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions.text import entities_sql
from harvestry.plans.views import table
from harvestry.registry import query
from harvestry.sources.dom import BATCH_TEXT, BLOCKS, HIDDEN, Elements

#: Elements that give nothing, not even what is in them.
DROPPED = HIDDEN | frozenset("iframe object embed canvas audio video head".split())
MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~", "s": "~", "strike": "~"}
SPECIAL = re.compile(r"([\\`*_\[\]])")


class Writer(Elements):
    """The elements' tree, with the Markdown of each open element gathered beside it; an element's end turns it into its parent's."""

    def __init__(self, html: str, base: str | None):
        self.base, self.parts, self.dropped = base, [[]], 0
        super().__init__(html)

    def markdown(self) -> str:
        text = re.sub(r"\n{3,}", "\n\n", "".join(self.parts[0]))
        text = re.sub(r"(?i)\[Skip to Content\]\(#[^)]*\)", "", text)
        depth, out = 0, []
        for c in text:  # a link's text goes on over a line's end by a backslash
            depth = depth + 1 if c == "[" else max(0, depth - 1) if c == "]" else depth
            out.append("\\\n" if c == "\n" and depth else c)
        return "".join(out).strip()

    def inside(self, *tags: str) -> bool:
        return any(self.tag[k] in tags for k in self.open)

    def add(self, text: str) -> None:
        if text and not self.dropped:
            self.parts[-1].append(text)

    def handle_starttag(self, tag, attrs):
        before = len(self.open)
        super().handle_starttag(tag, attrs)
        k = len(self.node) - 1
        if self.open[-1] == k and len(self.open) <= before + 1:
            self.parts.append([])
            self.dropped += tag in DROPPED
        elif tag == "br":
            self.add("  \n")
        elif tag == "hr":
            self.add("\n\n* * *\n\n")
        elif tag == "img" and self.attrs[k].get("src"):
            self.add(f"![{self.attrs[k].get('alt', '')}]({self.attrs[k]['src']})")

    def handle_data(self, data):
        super().handle_data(data)
        if self.inside("pre"):
            self.add(data)
        else:
            text = re.sub(r"[ \t\r\n\f]+", " ", data)
            self.add(text if self.inside("code") else SPECIAL.sub(r"\\\1", text))

    def link(self, text: str, attrs: dict) -> str:
        text, href = text.strip(), attrs["href"].strip()
        if not text:
            site = urlsplit(href).hostname if "://" in href else None
            text = attrs.get("aria-label", "").strip() or attrs.get("title", "").strip() or (site or "").replace("www.", "", 1) or "link"
        if self.base and "://" not in href and not href.startswith(("mailto:", "tel:")):
            href = urljoin(self.base, href)
        return f"[{text}]({href})"

    def pop(self) -> None:
        k = self.open[-1]
        super().pop()
        tag, attrs = self.tag[k], self.attrs[k]
        if k == 0:
            return
        text = "".join(self.parts.pop())
        if tag in DROPPED:
            self.dropped -= 1
            return
        self.add(self.turned(k, tag, attrs, text))

    def turned(self, k: int, tag: str, attrs: dict, text: str) -> str:
        bare = text.strip()
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {bare}\n\n" if bare else ""
        if tag == "p":
            return f"\n\n{bare}\n\n" if bare else ""
        if tag == "a" and attrs.get("href"):
            return self.link(text, attrs)
        if tag in MARKS and bare:
            return f"{text[: len(text) - len(text.lstrip())]}{MARKS[tag]}{bare}{MARKS[tag]}{text[len(text.rstrip()):]}"
        if tag == "code" and bare and not self.inside("pre"):
            return f"`{bare}`"
        if tag == "pre":
            return f"\n\n```\n{text.strip(chr(10))}\n```\n\n"
        if tag == "blockquote" and bare:
            return "\n\n" + "\n".join(f"> {line}".rstrip() for line in re.sub(r"\n{3,}", "\n\n", bare).split("\n")) + "\n\n"
        if tag == "li":
            parent = self.parent[k]
            number = f"{self.nth_of_type[k]}. " if self.tag[parent] == "ol" else "*   "
            return f"\n{number}" + re.sub(r"\n{2,}", "\n", bare).replace("\n", "\n    ")
        if tag in ("td", "th"):
            return "|" + re.sub(r"\s+", " ", bare).replace("|", "\\|")
        if tag == "tr":
            cells = [c for c, p in zip(self.tag, self.parent, strict=True) if p == k and c in ("td", "th")]
            line = "\n|" + " |".join(f" {c}" for c in re.split(r"(?<!\\)\|", text)[1:]) + " |" if bare else ""
            return line + ("\n|" + " --- |" * len(cells) if bare and self.first_row(k) else "")
        if tag in BLOCKS:
            return f"\n\n{text.strip(chr(10) + ' ')}\n\n" if bare else ""
        return text

    def first_row(self, k: int) -> bool:
        """Whether a row is the first of its table."""
        up = self.parent[k]
        while up > 0 and self.tag[up] != "table":
            up = self.parent[up]
        return not any(t == "tr" for t in self.tag[up + 1 : k])


def to_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown of pages (page_id, url, html). Null html gives ''; a null url leaves links as they are."""

    def run(batches):
        for batch in batches:
            ids, out, size = [], [], 0
            for page, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids.append(page.as_py())
                out.append(Writer(html.as_py() or "", url.as_py()).markdown())
                size += len(out[-1])
                if size >= BATCH_TEXT:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["page_id", "markdown"])
                    ids, out, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["page_id", "markdown"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, markdown string")


_marked = lambda c: f"regexp_replace({entities_sql(c)}, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g')"


@query(f"""with menu as (select page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) as link, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) as name, unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)))) as i from pages),
lists as (select page_id, string_agg('*   [' || {_marked('name')} || '](' || regexp_extract(url, '^(https?://[^/?#]+)', 1) || {entities_sql('link')} || ')', chr(10) order by i) as menu from menu group by page_id),
body as (select page_id, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) as ad, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as art, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) as foot from pages),
parts as (select page_id, unnest(string_split(art, '<p>')[2:]) as p, unnest(range(len(string_split(art, '<p>')) - 1)) as i from body),
told as (select page_id, i, {_marked("regexp_replace(p, '<[^>]+>', ' ', 'g')")} as t, starts_with(p, '<b>') as bold from parts),
texts as (select page_id, string_agg(case when bold then '**' || t || '**' else t end, chr(10) || chr(10) order by i) as text from told where t <> '' group by page_id)
select page_id, concat_ws(chr(10) || chr(10), menu, nullif({_marked('ad')}, ''), '# ' || {_marked("regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1)")}, text, nullif({_marked("replace(replace(foot, '&copy;', '©'), '&middot;', '·')")}, '')) as markdown
from body left join lists using (page_id) left join texts using (page_id)""")
def html_to_markdown(spark, d):
    return to_markdown(table(spark, d, "pages"))
