"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Each task's slice of the input is a memtable: it is sorted by digest and flushed as one immutable
run. The runs of a batch merge into a level-0 run with one entry per digest and the identifier that stays,
written with a bit filter of its digests. Once there are FAN level-0 runs, compaction merges them:
an entry whose digest is in no other run's filter passes as it is, only the rest meets by digest.
Digests met more than once are hits; only rows that pass the hits' bit filter are shuffled with
their texts, and each hit is compared byte for byte with the text of the row that stays. Texts that
differ under one digest are grouped by their bytes. All filters are of fixed size: full ones let more through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, staged

#: Bits of a filter; one row of FILTER_BITS / 64 longs.
FILTER_BITS = 1 << 20
#: Batches of a table, and runs of a level that are merged.
FAN = 4


def flush(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The sorted runs of all memtables: digest, id, arrival (unique for each row; its upper bits name the run)."""
    runs = docs.select(F.sha2(text.cast("binary"), 256).alias("digest"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("arrival"))
    return staged(runs.sortWithinPartitions("digest", "id"), "lsm-runs")


def merged(entries: DataFrame, keep: str = "min") -> DataFrame:
    """One entry per digest, sorted: digest, id, arrival, n. keep 'min' or 'max' of the identifiers; a null identifier stays only among nulls, ties go to the first arrival."""
    best = F.min_by if keep == "min" else F.max_by
    ids = entries.groupBy("digest", "id").agg(F.min("arrival").alias("arrival"), F.sum("n").alias("n"))
    one = ids.groupBy("digest").agg((F.min if keep == "min" else F.max)("id").alias("best"), F.coalesce(best("arrival", "id"), F.min("arrival")).alias("arrival"), F.sum("n").alias("n"))
    return one.select("digest", F.col("best").alias("id"), "arrival", "n").sortWithinPartitions("digest")


class Index:
    """Sorted runs of entries (digest, id, arrival, n), newest last, each with its filter. `add` batches of entries; runs of level 0 are compacted FAN at a time."""

    def __init__(self, keep: str = "min"):
        self.keep, self.runs = keep, []

    def add(self, entries: DataFrame) -> None:
        run = staged(merged(entries, self.keep), "lsm-level0")
        self.runs.append((0, run, staged(bit_filter(run), "lsm-filter")))
        while sum(level == self.runs[-1][0] for level, _, _ in self.runs) >= FAN:
            self.compact(self.runs[-1][0])

    def crossing(self, k: int, among: list) -> Column:
        """Whether an entry of run `k` may be in another run: a probe of the others' filters."""
        return reduce(lambda a, b: a | b, (in_filter(bits) for i, (_, _, bits) in enumerate(among) if i != k), F.lit(False))

    def compact(self, level: int) -> None:
        """Merge all runs up to `level` into one of the next."""
        some = [r for r in self.runs if r[0] <= level]
        rest = [r for r in self.runs if r[0] > level]
        alone = reduce(DataFrame.unionByName, (run.where(~self.crossing(k, some)) for k, (_, run, _) in enumerate(some)))
        meet = reduce(DataFrame.unionByName, (run.where(self.crossing(k, some)) for k, (_, run, _) in enumerate(some)))
        out = staged(alone.unionByName(merged(meet, self.keep)), f"lsm-level{level + 1}")
        self.runs = [*rest, (level + 1, out, staged(bit_filter(out), "lsm-filter"))]

    def find(self, digests: DataFrame) -> DataFrame:
        """The entries of these distinct digests, one for each: runs are read only for digests in their filters."""
        hits = [digests.where(in_filter(bits)).join(run, "digest") for _, run, bits in self.runs]
        return merged(reduce(DataFrame.unionByName, hits), self.keep)

    def entries(self) -> DataFrame:
        """All entries, one per digest, in one run."""
        if len(self.runs) > 1:
            self.compact(max(level for level, _, _ in self.runs))
        return self.runs[0][1]


def in_filter(bits: DataFrame) -> Column:
    """Whether a row's digest is in a (staged) filter."""
    slot = f"cast(pmod(xxhash64(digest), {FILTER_BITS}) as int)"
    word = F.element_at(bits.scalar(), F.expr(f"cast({slot} / 64 as int) + 1"))
    return word.bitwiseAND(F.expr(f"shiftleft(1L, {slot} % 64)")) != 0


def bit_filter(hits: DataFrame) -> DataFrame:
    """One row: the bits of all digests, as FILTER_BITS / 64 longs."""
    words = FILTER_BITS // 64
    slot = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)).cast("int")
    bits = hits.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(digest), {FILTER_BITS}) % 64 as int))").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = hits.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = every.unionByName(bits).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))


def verified(docs: DataFrame, hits: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Rows of hit digests whose bytes are not those of the row that stays: digest, id, text. Empty unless digests collide."""
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text")).withColumn("digest", F.sha2("text", 256))
    rows = rows.where(in_filter(staged(bit_filter(hits), "lsm-filter")))
    hit_rows = staged(rows.join(hits.select("digest", "keep_id"), "digest"), "lsm-hits")
    stays = hit_rows.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("kept_text"))
    stays = staged(stays, "lsm-stays")
    return hit_rows.join(stays, "digest").where(F.col("text") != F.col("kept_text")).select("digest", "id", "text")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; a null identifier is never preferred; of rows that repeat text and
    identifier one is kept; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = flush(docs, id_col, text)
    index = Index(keep)
    for batch in range(FAN):
        index.add(runs.where(F.pmod(F.shiftright("arrival", 33), F.lit(FAN)) == batch).withColumn("n", F.lit(1).cast("long")))
    entries = index.entries().select("digest", F.col("id").alias("keep_id"), F.col("arrival").alias("keep_arrival"), "n")
    differ = staged(verified(docs, entries.where("n > 1"), id_col, text), "lsm-collisions")
    out = runs.join(entries, "digest").select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("arrival") == F.col("keep_arrival")).alias("kept"), F.col("digest").alias("text_sha256"))
    if differ.isEmpty():
        return out
    # Digests that stand for several texts: their rows are grouped by the bytes themselves.
    bad = differ.select("digest").distinct()
    raw = docs.select(F.col(id_col), text.cast("binary").alias("bytes")).withColumn("text_sha256", F.sha2("bytes", 256)).join(bad.withColumnRenamed("digest", "text_sha256"), "text_sha256")
    groups = raw.groupBy("text_sha256", "bytes").agg((F.min if keep == "min" else F.max)(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    first = F.row_number().over(Window.partitionBy("text_sha256", "bytes", id_col).orderBy(F.lit(1))) == 1
    fixed = raw.join(groups, ["text_sha256", "bytes"]).withColumn("kept", first & F.col(id_col).eqNullSafe(F.col("keep_id")))
    return out.join(bad.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_anti").select(out.columns).unionByName(fixed.select(out.columns))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; of equal texts the row with the largest doc_id stays."""
    return dedup(documents(spark, sf_dir), keep="max")


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
