"""Chat formatting by quotation linking.

Messages are parsed into their own text and quoted blocks by level. Blocks, their paragraphs and their
longer lines are normalised and hashed (128 bits); a quoted passage belongs to the earliest message of its
conversation that says it, and a block to the message of a whole passage before that of a line alone, so
that trimmed quotes are linked too. The first outermost block that is found names the message replied to;
following those links gives each message its thread and depth. In reply order each message is followed by
its replies with all that answers them, before the next reply to the message before: the conversation
without quotes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .batches import slices, values
from .common import staged

MARK = re.compile(r"[ \t]?(?:>[ \t]?)+")
#: Messages of a thread put into one array at most; a longer thread continues in the next one.
CHUNK = 256
#: Characters of a line that is a passage of its own.
LINE = 20


def blocks(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines) of each stretch of lines with as many '>' before them."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        mark = MARK.match(line)
        level = mark[0].count(">") if mark else 0
        rest = line[mark.end() :] if mark else line
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    return out


def passage_hash(text: str) -> bytes:
    """Of the text in lower case with single spaces; empty if there is nothing."""
    normal = " ".join(text.lower().split())
    return xxh3_128_digest(normal.encode("utf-8", "replace")) if normal else b""


def passages(lines: list[str]) -> dict[bytes, int]:
    """Hashes of the whole block and its paragraphs (0), and of its longer lines, if there are several lines (1)."""
    parts, part = [], []
    for line in [*lines, ""]:
        if line.strip():
            part.append(line)
        elif part:
            parts.append("\n".join(part))
            part = []
    found = dict.fromkeys((passage_hash("\n".join(lines)), *map(passage_hash, parts)), 0)
    for line in lines if len(lines) > 1 else ():
        if len(line.strip()) >= LINE:
            found.setdefault(passage_hash(line), 1)
    found.pop(b"", None)
    return found


def parsed(text: str) -> tuple[str, list[bytes], list[tuple[int, int, int, bytes]]]:
    """A message's own text, the hashes of what it says, and (block, level, kind, hash) of what it quotes. A line ending in ':' just before a quote introduces it and goes."""
    own, said, quoted = [], [], []
    every = blocks(text)
    for i, (level, lines) in enumerate(every):
        if level:
            quoted += [(i, level, kind, h) for h, kind in passages(lines).items()]
            continue
        if i + 1 < len(every):
            lines = lines[:-1] if lines[-1].rstrip().endswith(":") else lines
        own += lines
    body = "\n".join(own).strip("\n")
    return body, [*passages(body.split("\n"))], quoted


def parse(messages: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("conv_id", "turn", "role")) -> DataFrame:
    """carry, body, said (hashes), quoted (block, level, kind, hash). Bytes that are not UTF-8 are replaced."""

    def run(batches):
        kind = pa.list_(pa.struct([("block", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("hash", pa.binary())]))
        for part, data, at in slices(batches, "chat_text"):
            rows = [parsed(data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(part.num_rows)]
            quoted = [[dict(zip(("block", "level", "kind", "hash"), q, strict=True)) for q in each] for _, _, each in rows]
            yield pa.RecordBatch.from_arrays([*(values(part, c) for c in carry), pa.array([b for b, _, _ in rows], pa.string()), pa.array([s for _, s, _ in rows], pa.list_(pa.binary())), pa.array(quoted, kind)], names=[*carry, "body", "said", "quoted"])

    kinds = ", ".join(f"`{c}` {messages.schema[c].dataType.simpleString()}" for c in carry)
    return messages.select(*carry, F.col(text_col).cast("string").alias("chat_text")).mapInArrow(run, f"{kinds}, body string, said array<binary>, quoted array<struct<block: int, level: int, kind: int, hash: binary>>")


def roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to -> thread_root, depth, by pointer doubling: as many rounds as the logarithm of the longest chain.

    Only messages that do not point to a root yet take part in a round; the others are looked up.
    """
    start = F.coalesce("reply_to", "turn").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("reply_to").isNull().alias("done")
    now = staged(links.select("conv_id", "turn", *start), "chat-links")
    settled, active = now.where("done"), now.where("not done")
    while not active.isEmpty():
        above = settled.unionByName(active).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("done").alias("done2"))
        jumped = active.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("done2", F.lit(True)).alias("done"))
        new = staged(jumped, "chat-links")
        settled, active = settled.unionByName(new.where("done")), new.where("not done")
    return settled.select("conv_id", "turn", F.col("up").alias("thread_root"), "depth")


def reply_order(placed: DataFrame) -> DataFrame:
    """placed: conv_id, turn, reply_to, thread_root, depth -> with position, from 0 in each thread.

    What follows a message is its first reply, or else the next reply to the nearest message above that has
    one. These links are a list through the thread, ranked by pointer doubling from its end.
    """
    siblings = Window.partitionBy("conv_id", "reply_to").orderBy("turn")
    later = placed.withColumn("sibling", F.when(F.col("reply_to").isNotNull(), F.lead("turn").over(siblings)))
    first = placed.where("reply_to is not null").groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = staged(later.join(first, ["conv_id", "turn"], "left"), "chat-tree")
    above = roots(nodes.select("conv_id", "turn", F.when(F.col("sibling").isNull(), F.col("reply_to")).alias("reply_to")))
    turns = above.select("conv_id", "turn", F.col("thread_root").alias("branch")).join(nodes.select("conv_id", F.col("turn").alias("branch"), F.col("sibling").alias("after")), ["conv_id", "branch"])
    listed = staged(nodes.join(turns.select("conv_id", "turn", "after"), ["conv_id", "turn"]).withColumn("follows", F.coalesce("child", "after")), "chat-list")
    ranked = roots(listed.select("conv_id", "turn", F.col("follows").alias("reply_to"))).select("conv_id", "turn", F.col("depth").alias("to_end"))
    out = staged(placed.join(ranked, ["conv_id", "turn"]), "chat-ranked")
    most = staged(out.groupBy("conv_id", "thread_root").agg(F.max("to_end").alias("last")), "chat-threads")
    return out.join(most, ["conv_id", "thread_root"]).withColumn("position", F.col("last") - F.col("to_end")).drop("last", "to_end")


def threaded(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, reply_to, thread_root, depth, position, n_quotes, n_linked, links, body; one row per message.

    reply_to: the turn of the message whose passage the first outermost quoted block repeats, null if
    there is none. position: place in the thread in reply order, from 0. links: (block, level, said_at) of
    each quoted block, of any level, that was found. Null text is an empty body. Rows that repeat a
    conversation and turn are kept, and linked as one message. A null conversation or turn is linked with
    nothing. Texts are parsed in slices, a very long one in a slice of its own; other columns are ignored.
    """
    rows = staged(parse(messages, text_col), "chat-parsed")
    first = staged(rows.select("conv_id", "turn", F.explode("said").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("said_at")), "chat-said")
    quotes = rows.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*")
    found = quotes.join(first, ["conv_id", "hash"]).where("said_at < turn").groupBy("conv_id", "turn", "block", "level").agg(F.min(F.struct("kind", "said_at"))["said_at"].alias("said_at"))
    level1 = F.min(F.when(F.col("level") == 1, F.struct("block", "said_at")))
    linked = staged(found.groupBy("conv_id", "turn").agg(level1["said_at"].alias("reply_to"), F.count("*").alias("n_linked"), F.array_sort(F.collect_list(F.struct("block", "level", "said_at"))).alias("links")), "chat-linked")
    nodes = rows.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct().join(linked.select("conv_id", "turn", "reply_to"), ["conv_id", "turn"], "left")
    nodes = staged(nodes, "chat-nodes")
    placed = staged(nodes.join(roots(nodes), ["conv_id", "turn"]), "chat-roots")
    placed = reply_order(placed).drop("reply_to")
    placed = staged(placed.join(linked, ["conv_id", "turn"], "left"), "chat-placed")
    n_quotes = F.size(F.array_distinct(F.transform("quoted", lambda q: q["block"]))).cast("long")
    out = rows.join(placed, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), zero("depth"), zero("position"), n_quotes.alias("n_quotes"), zero("n_linked"), "links", "body")


def assembled(threads: DataFrame) -> DataFrame:
    """conv_id, thread_root, chunk, messages (position, turn, role, body; in reply order, at most CHUNK places): conversations without quotes."""
    item = F.struct("position", "turn", "role", "body")
    return threads.groupBy("conv_id", "thread_root", F.floor(F.col("position") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("messages"))


def as_mail(messages: DataFrame, levels: int = 2) -> DataFrame:
    """conv_id, turn, role, text: each message as mail programs send it, its text above the `levels` messages before it, quoted, one level deeper each."""
    quote = messages.where("text is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", F.col("m.role").alias("by"), F.col("m.text").alias("said"))
    quote = staged(quote, "chat-quotes")
    out, text = messages.select("conv_id", "turn", "role", "text"), F.coalesce("text", F.lit(""))
    for level in range(1, levels + 1):
        own = quote.select("conv_id", (F.col("turn") + level).alias("turn"), F.col("by").alias(f"by{level}"), F.col("said").alias(f"said{level}"))
        out = out.join(own, ["conv_id", "turn"], "left")
        marks = ">" * level + " "
        intro = F.concat(F.coalesce(f"by{level}", F.lit("")), F.lit(" wrote:\n")) if level == 1 else F.lit("")
        text = F.concat(text, F.when(F.col(f"said{level}").isNotNull(), F.concat(F.lit("\n"), intro, F.regexp_replace(f"said{level}", "(?m)^", marks))).otherwise(""))
    return out.select("conv_id", "turn", "role", text.alias("text"))


def op1_quote_linking(spark, sf_dir: str) -> DataFrame:
    """All conversations, in mail form: quotes taken out, linked to their messages, replies in order."""
    found = threaded(as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    turns = F.array_sort(F.array_distinct(F.transform("links", lambda x: x["said_at"])))
    return found.withColumn("linked_turns", F.coalesce(F.array_join(turns, ","), F.lit(""))).drop("links")


ORACLE = r"""
with recursive m as (select conv_id, turn, role, coalesce(text, '') as t, text is not null as there from conversations),
pas as (select conv_id, turn, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) as n
        from (select conv_id, turn, unnest(list_distinct(list_prepend(t, string_split_regex(t, '\n[ \t]*\n')))) as p from m)),
said as (select conv_id, n, min(turn) as s from pas where n <> '' group by all),
blocks as (select m.conv_id, m.turn, m.turn - q.turn as level, min(s.s) filter (where s.s < m.turn) as at
           from m join m q on q.conv_id = m.conv_id and q.turn in (m.turn - 1, m.turn - 2) and q.there
           left join pas p on p.conv_id = q.conv_id and p.turn = q.turn left join said s on s.conv_id = p.conv_id and s.n = p.n group by all),
links as (select m.conv_id, m.turn, m.role, m.t, min(b.at) filter (where b.level = 1) as reply_to, count(b.level) as n_quotes, count(b.at) as n_linked,
          coalesce(array_to_string(list_sort(list_distinct(list(b.at) filter (b.at is not null))), ','), '') as linked_turns
          from m left join blocks b using (conv_id, turn) group by all),
walk as (select conv_id, turn, turn as thread_root, 0 as depth, [turn] as path from links where reply_to is null
         union all select l.conv_id, l.turn, w.thread_root, w.depth + 1, list_append(w.path, l.turn) from links l join walk w on w.conv_id = l.conv_id and w.turn = l.reply_to)
select l.conv_id, l.turn, l.role, l.reply_to, w.thread_root, w.depth::bigint as depth,
       row_number() over (partition by l.conv_id, w.thread_root order by w.path) - 1 as position, n_quotes, n_linked, linked_turns, trim(t, chr(10)) as body
from links l join walk w using (conv_id, turn)
"""
