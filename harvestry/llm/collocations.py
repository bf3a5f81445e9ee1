"""Phrase collocations: n-grams as rows, counted per language, scored against their parts, the best of each language ranked.

Texts are cut at punctuation, and n-grams become rows (lang, phrase, n), level by level. A phrase can
only be frequent if its parts are, so a row is made for an n-gram of n > 1 words only if both its
(n-1)-grams are in the bit filter of the frequent ones: a filter of bounded size that, when full, lets more
through and never loses one. A task adds up equal n-grams of a slice of text before it passes
them on. Counts of first and last parts join by phrase; scores are whole numbers of Decimal(38);
a phrase that a one-word extension mostly stands for goes by an anti-join; ranks come from the best
of parts of a language, so that no language is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import mixed, slices, values
from .common import documents, join_small, staged
from .shingles import powers

MAX_N, LEAST, SHARE, BEST = 3, 10, 50, 2000
#: Where pieces end: . , ; : ! ? and the controls 10 to 13.
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK = np.zeros(256, bool)
BLANK[list(b" \t")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text whose n-grams are held at once; a longer text is cut between words.
PART = 2 << 20
#: Bits of a level's filter: this many for each frequent phrase, and at most 2^26 (8 MB).
BITS_EACH, MOST_BITS = 16, 26
#: Parts of a language that are ranked by themselves first.
SALTS = 64


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased bytes, and the number of its piece, which no two texts share."""
    black = ~(BLANK | ENDS)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1] | edge[1:-1]
    ends[:-1] &= ~black[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    piece = np.cumsum(ENDS[data] | edge[:-1])
    return s, e, piece[s]


def hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    _, offsets, raw = dictionary.buffers()
    off = np.frombuffer(offsets, np.int64)[dictionary.offset : dictionary.offset + len(dictionary) + 1]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if len(dictionary) else np.zeros(0, np.uint8)
    off = off - off[0]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[off[1:]] - total[off[:-1]]) * down[off[:-1]] + np.diff(off).astype(np.uint64))


def lang_hash(lang: str) -> np.uint64:
    return hashes(pa.array([lang.encode()], pa.large_binary()))[0]


def gram_hashes(word: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
    """Hash of the n words from each word on, and of the language; the last n - 1 places are of no use."""
    out = lang.copy()
    for k in range(n):
        out[: len(word) - k] = out[: len(word) - k] * np.uint64(0x9FB21C651E98DF25) + word[k:]
        out = mixed(out)
    return out


class Words:
    """The words of some texts: `code` into `dictionary`, the language of each and its piece."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang_of_text: np.ndarray):
        data = LOWER[data]
        s, e, self.piece = word_spans(data, at)
        keep = ~(BLANK | ENDS)[data]
        ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(data[keep])])
        coded = packed.dictionary_encode() if len(s) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), packed)
        self.code, self.dictionary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.lang = lang_of_text[np.searchsorted(at, s, "right") - 1]

    def counts(self, n: int, allowed: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Language, codes of the n words and count of each different n-gram; allowed: which words an (n-1)-gram that may be frequent begins at."""
        m = max(0, len(self.code) - n + 1)
        ok = self.piece[:m] == self.piece[n - 1 : n - 1 + m]
        if allowed is not None:
            ok &= allowed[:m] & allowed[1 : m + 1]
        where = np.flatnonzero(ok)
        size, key, room = max(1, len(self.dictionary)), self.lang[where].astype(np.int64), int(self.lang.max(initial=0)) + 1
        for k in range(n):
            if room * size >= 1 << 62:  # keys become numbers in a row again
                seen, key = np.unique(key, return_inverse=True)
                room = len(seen)
            key, room = key * size + self.code[where + k], room * size
        _, first, many = np.unique(key, return_index=True, return_counts=True)
        where = where[first]
        return self.lang[where], [self.code[where + k] for k in range(n)], many


class BitFilter:
    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words) * 64

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h & np.uint64(self.bits - 1)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def cut(batches, text_col: str, lang_col: str, overlap: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(bytes, offsets, languages); a long text comes in parts cut between words, each with the last `overlap` words before it, too few for an n-gram of their own."""
    stop = BLANK | ENDS
    for rows, data, at in slices(batches, text_col, limit):
        langs = values(rows, lang_col).to_pylist()
        if len(data) <= 2 * limit:
            yield data, at, langs
            continue
        begin, again = 0, 0
        while begin < len(data):
            end = min(len(data), begin + limit)
            while end < len(data) and not (stop[data[end]] or stop[data[end - 1]]):
                end += 1
            part = data[again:end]
            yield part, np.array([0, len(part)]), langs
            s, _, piece = word_spans(part, np.array([0, len(part)]))
            last = s[-overlap:][piece[-overlap:] == piece[-1]] if overlap and len(s) else s[:0]
            begin, again = end, (again + int(last[0]) if len(last) else end)


def exploded(docs: DataFrame, n: int, parts: np.ndarray | None, text_col: str = "text", lang_col: str = "lang", part: int = PART) -> DataFrame:
    """lang, phrase, n: the n-grams of all texts, counted by slice; parts: bits of the frequent (n-1)-grams."""
    held = docs.sparkSession.sparkContext.broadcast(parts) if parts is not None else None  # 8 MB at most

    def run(batches):
        seen = BitFilter(held.value) if held else None
        codes: dict[str, int] = {}
        lang_hashes = np.zeros(0, np.uint64)
        for data, at, langs in cut(batches, text_col, lang_col, n - 1, part):
            for x in langs:
                if x not in codes:
                    codes[x] = len(codes)
                    lang_hashes = np.append(lang_hashes, lang_hash(x))
            words = Words(data, at, np.array([codes[x] for x in langs], np.int64))
            if not len(words.code):
                continue
            allowed = seen.has(gram_hashes(hashes(words.dictionary)[words.code], n - 1, lang_hashes[words.lang])) if seen else None
            lang, own, many = words.counts(n, allowed)
            dictionary = words.dictionary.cast(pa.large_string())
            for i in range(0, len(lang), 1 << 16):
                columns = [dictionary.take(pa.array(c[i : i + (1 << 16)])) for c in own]
                phrase = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if n > 1 else columns[0]
                names = pa.array(list(codes), pa.string()).take(pa.array(lang[i : i + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([names, phrase.cast(pa.string()), pa.array(many[i : i + (1 << 16)])], names=["lang", "phrase", "n"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias(lang_col)).mapInArrow(run, "lang string, phrase string, n long")


def frequent_bits(frequent: DataFrame, n: int) -> np.ndarray:
    """The filter of the phrases (n words each) of `frequent`, which is staged."""
    bits = int(min(MOST_BITS, max(10, np.ceil(np.log2(BITS_EACH * max(1, frequent.count()))))))

    def run(batches):
        table = np.zeros(1 << (bits - 6), np.uint64)
        for rows, data, at in slices(batches, "phrase"):
            if not rows.num_rows:
                continue
            names = values(rows, "lang").to_pylist()
            known = {x: lang_hash(x) for x in set(names)}
            s, e, _ = word_spans_of_phrases(data, at)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)), pa.py_buffer(data[data != 32])])
            h = gram_hashes(hashes(packed), n, np.repeat(np.array([known[x] for x in names], np.uint64), n))[::n]
            slot = h & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(table, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        for k, block in enumerate(np.array_split(table, max(1, len(table) >> 10))):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["block", "bits"])

    def joined(rows):
        table = np.bitwise_or.reduce([np.frombuffer(x, np.uint64) for x in rows.column("bits").to_pylist()])
        return pa.table({"block": rows.column("block").slice(0, 1), "bits": pa.array([table.tobytes()], pa.binary())})

    found = frequent.mapInArrow(run, "block int, bits binary").groupBy("block").applyInArrow(joined, "block int, bits binary").toArrow()  # 8 MB at most
    table = np.array_split(np.zeros(1 << (bits - 6), np.uint64), max(1, (1 << (bits - 6)) >> 10))
    for k, x in zip(found["block"].to_pylist(), found["bits"].to_pylist(), strict=True):
        table[k] = np.frombuffer(x, np.uint64)
    return np.concatenate(table)


def word_spans_of_phrases(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of space-joined phrases: their other signs are none that end a word."""
    black = data != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1] | edge[1:-1]
    ends[:-1] &= ~black[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1, at


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", part: int = PART) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to max_n words that occur `least` times (lang, size, phrase, f), and the word occurrences of each language (lang, n)."""
    levels, words, bits = [], None, None
    for n in range(1, max_n + 1):
        counted = exploded(docs, n, bits, text_col, lang_col, part).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if n == 1:
            counted = staged(counted, "phrases-words")
            words = staged(counted.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals")
        level = counted.where(F.col("f") >= least).select("lang", F.lit(n).alias("size"), "phrase", "f")
        levels.append(staged(level, f"phrases-{n}"))
        if n < max_n:
            bits = frequent_bits(levels[-1], n)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, words


def scored(counts: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """lang, size, phrase, a, l, r, score of all phrases of two words or more: the cut with the lowest score, the first of those."""
    parts = F.split("phrase", " ", -1)
    many = counts.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    many = many.withColumn("head", F.array_join(F.slice(parts, 1, F.col("k")), " ")).withColumn("tail", F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    part = counts.where(F.col("size") < max_n)
    many = many.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    many = many.join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    d = lambda c: F.col(c).cast("decimal(16,0)")
    many = many.withColumn("top", (d("f") * d("f") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("below", (d("l") * d("r")).cast("decimal(38,0)"))
    many = many.withColumn("score", F.expr("cast(top div below as bigint)"))
    best = many.groupBy("lang", "size", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "size", "phrase", F.col("f").alias("a"), "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, best: int = BEST, text_col: str = "text", lang_col: str = "lang", part: int = PART) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Null text is empty, null language is `und`; texts without words, and phrases below `least`, give no rows; repeated
    rows count again; other columns are ignored, whatever their names. Equal scores go by count, then by the phrase's
    bytes. A longer phrase hides a shorter one inside it if it makes up `share` percent of it; it is enough to look
    at extensions by one word, as a part is at least as frequent as what holds it.
    """
    counts, words = phrase_counts(docs, max_n, least, text_col, lang_col, part)
    found = staged(scored(counts, max_n), "phrases-scored")
    parts = F.split("phrase", " ", -1)
    inside = found.where("size > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(parts, 1, F.col("size") - 1), " "), F.array_join(F.slice(parts, 2, F.col("size") - 1), " "))).alias("phrase"))
    hidden = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(hidden.withColumnRenamed("longer", "b"), ["lang", "phrase"], "left").where(F.col("b").isNull() | (F.col("b") * 100 < F.col("a") * share)).drop("b")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = Window.partitionBy("lang", "salt").orderBy(*order)
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)  # SALTS * best rows of a language
    return join_small(top, words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """All documents: the best phrases of two and three words of each language."""
    return collocations(documents(spark, sf_dir))


ORACLE = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
lists as (select lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as list from pieces),
words as (select lang, p, generate_subscripts(list, 1) as i, unnest(list) as w1 from lists),
runs as (select lang, w1, lead(w1, 1) over d as w2, lead(w1, 2) over d as w3 from words window d as (partition by p order by i)),
grams as materialized (
  select lang, 1 as size, w1 as phrase, count(*) as f from runs group by all
  union all select lang, 2, w1 || ' ' || w2, count(*) from runs where w2 is not null group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from runs where w3 is not null group by all),
totals as (select lang, sum(f) as n from grams where size = 1 group by lang),
cuts as (
  select lang, phrase, size, f as a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') as head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as tail
  from grams, (select unnest([1, 2]) as k) where k < size and f >= {LEAST}),
halves as (
  select c.lang, c.phrase, c.size, a, k, h.f as l, t.f as r, (1000000 * a::hugeint * a) // (h.f::hugeint * t.f) as score
  from cuts c join grams h on h.lang = c.lang and h.phrase = head join grams t on t.lang = c.lang and t.phrase = tail),
best as (select * from halves qualify row_number() over (partition by lang, phrase order by score, k) = 1),
hidden as (
  select distinct s.lang, s.phrase from best s join best b on b.lang = s.lang and b.size = 3 and s.size = 2
  and (starts_with(b.phrase, s.phrase || ' ') or ends_with(b.phrase, ' ' || s.phrase)) and 100 * b.a >= {SHARE} * s.a),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, score::bigint as score
  from best anti join hidden using (lang, phrase))
select lang, rank, phrase, a, l, r, n::bigint as n, score from ranked join totals using (lang) where rank <= {BEST}
"""
