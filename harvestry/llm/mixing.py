"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is its weight's share of the whole size, at most `cap` times the source's own
size; what is above is shared again by weight. Target over source size is the copies expected: the
whole part are certain copies of every document, the rest is sampled. A document's inclusion
probability p grows with the square root of its size, longer documents being worth more for their
length, and is one at most; p * size adds up to the words asked for. Ranks are random odds over
inclusion odds, q = u/(1-u) / (p/(1-p)). The sample has a fixed size in words: documents are taken in
rank order as long as they fit. The threshold is found from sums over rank cells, refined until
single rows are left, so that no source is ever sorted in one task. The words that the first document
that does not fit leaves open are made up from the source's histogram of sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, join_small, staged

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Rank cells of each of the two refinements.
CELLS = 2048
#: What places a row in the order of ranks: two refinements of q, then q itself with what tells its text, then, among rows alike in all that, where they are in the input.
LEVELS = ("c1", "c2", "tie", "part", "row")
#: Sizes that an exchange is tried with, of either kind.
TRIES = 32
CLASSES = "array<struct<size: bigint, m: bigint>>"


def spot() -> Column:
    return F.struct("tie", "row")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size -> with target. One row per source, so windows over all of them hold source names only.

    Sources in code-point order, null last, take the weights in turn. Capped sources are those with
    the smallest cap * size / weight; the first level that the next ratio bears is the answer.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("w"))
    left_words = F.sum("source_size").over(every) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))
    left_weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left_words / left_weight).withColumn("nth", F.row_number().over(ratio))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(every)["level"]
    target = F.least(F.lit(cap) * F.col("source_size"), F.col("w") * F.coalesce(level, F.lit(0.0)))
    return rows.select("source", "source_size", F.round(target, 6).alias("target"))


def uniform(seed: int) -> F.Column:
    """A number in (0, 1) from the identifier and the text, the same in every run and in any SQL engine with md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("mark")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def inclusion(rows: DataFrame) -> DataFrame:
    """rows: g, size, part_wanted (share of the source's words to sample) -> with p = min(1, c * sqrt(size)), c for each source so that p * size adds up.

    From the histogram of sizes: with all sizes above some one certain, c follows; the largest size that this c does not make certain is right.
    """
    sizes = rows.where("size > 0").groupBy("g", "size").agg(F.count("*").alias("n"), F.max("part_wanted").alias("part_wanted"))
    down = Window.partitionBy("g").orderBy(F.desc("size"))
    words, root = F.col("size") * F.col("n"), F.sqrt("size")
    certain = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(root * words).over(Window.partitionBy("g")) - F.coalesce(F.sum(root * words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    c = (F.col("part_wanted") * F.sum(words).over(Window.partitionBy("g")) - certain) / rest
    found = sizes.withColumn("c", c).where(F.col("c") * root <= 1 + 1e-9).groupBy("g").agg(F.max_by("c", "size").alias("c"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("c", F.lit(0.0)) * root))
    p = F.when(p > 1 - 1e-9, 1.0).when(p < 1e-12, 0.0).otherwise(p)
    return join_small(rows, staged(found, "mix-inclusion"), "g", "left").withColumn("p", p).drop("c")


def below(rows: DataFrame, keys: list[str], cell: str, amount: Column, limits: DataFrame) -> DataFrame:
    """For each group the first cell at which `amount`, added up, passes `want`: keys, that cell, want less the cells before it."""
    sums = rows.groupBy(*keys, cell).agg(F.sum(amount).alias("some"))
    run = Window.partitionBy(*keys).orderBy(cell)
    sums = join_small(sums, limits, keys).withColumn("upto", F.sum("some").over(run))
    passed = F.min(F.when(F.col("upto") > F.col("want"), F.struct(cell, (F.col("want") - F.col("upto") + F.col("some")).alias("rest"))))
    return sums.groupBy(*keys).agg(passed.alias("x")).where("x is not null").select(*keys, F.col(f"x.{cell}").alias(f"at_{cell}"), F.col("x.rest").alias("want"))


def cuts(rows: DataFrame, keys: list[str], amount: Column, asked: DataFrame) -> DataFrame:
    """For each group of `asked` (keys, want) the row in rank order at which `amount`, added up, first passes `want`: keys, stop, want less what is before it. Groups that never pass it are left out."""
    edge, want = rows, asked
    for level in LEVELS:
        want = staged(below(edge, keys, level, amount, want), "mix-cell")
        edge = join_small(edge, want.select(*keys, f"at_{level}"), keys).where(F.col(level) == F.col(f"at_{level}")).drop(f"at_{level}")
        if level == "c2":
            edge = staged(edge, "mix-edge")
        want = want.select(*keys, "want")
    return staged(edge.select(*keys, spot().alias("stop")).join(want, keys), "mix-cut")


def greedy(start: Column, sizes: Column, room: Callable[[Column, Column], Column], sign: int) -> Column:
    """Sizes from the largest on: `room` documents of each (given the words still wanted and the size) are taken, or given back if sign is -1. The words still wanted, and the sizes changed with their new number."""

    def step(s, x):
        k = F.greatest(F.lit(0), room(s["gap"], x)).cast("long")
        put = F.struct(x["size"].alias("size"), (x["taken"] + sign * k).alias("m"))
        return F.when(k > 0, F.struct((s["gap"] - sign * k * x["size"]).alias("gap"), F.array_append(s["classes"], put).alias("classes"))).otherwise(s)

    return F.aggregate(sizes, start, step)


def takes(gap: Column, x: Column) -> Column:
    return F.least(x["n"] - x["taken"], F.floor(gap / x["size"]))


def filled(gap: Column, sizes: Column) -> Column:
    """Documents still free, as many of each size as fit the gap."""
    return greedy(F.struct(gap.cast("double").alias("gap"), F.array().cast(CLASSES).alias("classes")), sizes, takes, 1)


def exchanged(gap: Column, sizes: Column) -> Column:
    """Exchanges: one more document of a size, and others given back as they fit what that is too much; or one given back, and others taken as they fit. Each of the TRIES smallest sizes begins one."""

    def smallest(some):
        return F.slice(F.reverse(F.filter(sizes, some)), 1, TRIES)

    def start(y, sign):
        return F.struct((gap - sign * y["size"]).cast("double").alias("gap"), F.array(F.struct(y["size"].alias("size"), (y["taken"] + sign).alias("m"))).cast(CLASSES).alias("classes"))

    def other(y, n):
        return lambda g, x: F.when(x["size"] != y["size"], n(g, x)).otherwise(0)

    more = F.transform(smallest(lambda x: x["n"] > x["taken"]), lambda y: greedy(start(y, 1), sizes, other(y, lambda g, x: F.least(x["taken"], F.floor(-g / x["size"]))), -1))
    less = F.transform(smallest(lambda x: x["taken"] > 0), lambda y: greedy(start(y, -1), sizes, other(y, takes), 1))
    return F.concat(more, less)


def settled(live: DataFrame, cut: DataFrame) -> DataFrame:
    """g, size, m: the sizes of which not those before the cut are taken but the first m in rank order, so that the words taken come as near to what is wanted as whole documents allow.

    Decided on the histogram of sizes: a row for each source, as long as it has different sizes.
    """
    sizes = join_small(live, cut, "g").groupBy("g", "size").agg(F.count("*").alias("n"), F.count_if(spot() < F.col("stop")).alias("taken"))
    down = F.reverse(F.array_sort(F.collect_list(F.struct("size", "n", "taken"))))
    rows = sizes.groupBy("g").agg(down.alias("sizes")).join(cut.select("g", F.col("want").alias("gap")), "g")
    rows = rows.withColumn("fill", filled(F.col("gap"), F.col("sizes")))
    # The sizes as they are after the fill; then the exchange that leaves least, if it leaves less than the fill.
    rows = rows.withColumn("made", F.map_from_entries("fill.classes"))
    after = F.transform("sizes", lambda x: F.struct(x["size"].alias("size"), x["n"].alias("n"), F.coalesce(F.try_element_at(F.col("made"), x["size"]), x["taken"]).alias("taken")))
    rows = rows.withColumn("after", after)
    tries = F.transform(exchanged(F.col("fill.gap"), F.col("after")), lambda t: F.struct(F.abs(t["gap"]).alias("miss"), t["classes"].alias("classes")))
    rows = rows.withColumn("best", F.array_min(F.array_append(tries, F.struct(F.abs(F.col("fill.gap")).alias("miss"), F.array().cast(CLASSES).alias("classes")))))
    both = F.map_concat(F.map_filter("made", lambda k, _: ~F.exists("best.classes", lambda c: c["size"] == k)), F.map_from_entries("best.classes"))
    return staged(rows.select("g", F.explode(both).alias("size", "m")), "mix-classes")


def pareto_sample(rows: DataFrame) -> DataFrame:
    """rows: g (source), row, id, mark, size, p, u -> with boolean `taken`, each source's words close to sum(p * size).

    Documents are taken in the order of q up to the first that does not fit. What is then still wanted is made up from the
    histogram of sizes (`settled`); of a size whose number is changed, the documents first in that order are taken. Rows
    without words or with p = 0 are not taken.
    """
    q = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p")))
    rows = rows.withColumn("q", q).withColumn("tie", F.struct("q", "id", "mark")).withColumn("part", F.shiftright("row", 33))
    scaled = F.col("q") / (1 + F.col("q")) * CELLS
    rows = staged(rows.withColumn("c1", F.floor(scaled)).withColumn("c2", F.floor((scaled - F.floor(scaled)) * CELLS)), "mix-ranked")
    live = rows.where("q is not null and size > 0")
    asked = staged(live.groupBy("g").agg(F.sum(F.col("p") * F.col("size")).alias("want")), "mix-want")
    cut = cuts(live, ["g"], F.col("size"), asked)
    classes = settled(live, cut)
    members = join_small(live, classes.select("g", "size"), ["g", "size"])
    within = cuts(members, ["g", "size"], F.lit(1), classes.select("g", "size", F.col("m").cast("double").alias("want")))
    own = staged(classes.join(within.select("g", "size", F.col("stop").alias("own_stop")), ["g", "size"], "left").select("g", "size", "own_stop", F.lit(True).alias("own")), "mix-own")
    out = join_small(join_small(rows, cut.select("g", "stop"), "g", "left"), own, ["g", "size"], "left")
    stop = F.when(F.col("own"), F.col("own_stop")).otherwise(F.col("stop"))
    taken = F.col("q").isNotNull() & (F.col("size") > 0) & (stop.isNull() | (spot() < stop))
    return out.withColumn("taken", taken).drop("stop", "own_stop", "own", "tie", "part", "c1", "c2")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP, seed: int = 1) -> DataFrame:
    """One row per document: id_col, source, size, source_size, target, p, copies, taken (= copies * size).

    Size is the number of words; null text has none. A null source is a source of its own. Documents
    without words are never copied. Rows that repeat an id, or have none, are told apart by their texts; rows
    alike in both are ranked together and as many taken as fit. Other columns are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("mark"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "mix-sized")
    plan = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap).withColumn("g", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "mix-targets")
    rows = join_small(sized, plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    share = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    certain = F.least(F.floor(share + 1e-9), F.lit(int(cap))).cast("long")
    rows = rows.withColumn("certain", certain).withColumn("part_wanted", F.greatest(F.lit(0.0), F.when(share - certain < 1e-9, 0.0).otherwise(share - certain)))
    rows = inclusion(rows).withColumn("u", uniform(seed))
    copies = F.when(F.col("size") > 0, F.col("certain") + F.col("taken").cast("long")).otherwise(F.lit(0)).cast("long")
    out = pareto_sample(rows).withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """All documents: the words that the mix takes from each."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "copies", "taken")
