"""Near-duplicate detection by one-permutation hashing with optimal densification.

Texts with the same shingle set are one class, with a number of its own. Each class
hashes its shingles once; the smallest hash in each bin is the signature, and an empty bin copies the
bin that its own hash sequence first finds filled. Bands of the signature are buckets. A bucket
gives a star of candidate edges, from its hub to the others, never all pairs: the hub is the
member whose buckets are largest, the centre of its copies. The stars join the bulk cheaply: members of
buckets that still hold several components then meet in an exact prefix join, so that every pair in
one bucket is linked or ruled out. Candidates are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import mixed, slices, values
from .common import documents, staged
from .graph import components
from .shingles import shingle_sets

WORDS, BANDS, ROWS = 5, 32, 4
LEVEL = 80
#: Bits of the filter that keeps rows without candidates out of the shuffle of sets.
FILTER_BITS = 1 << 20


def signatures(sets: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures, one row of `bins` hashes for each non-empty set; an empty set's row means nothing."""
    texts = len(at) - 1
    owner = np.repeat(np.arange(texts), np.diff(at))
    bin_of = (sets >> np.uint64(32)) % np.uint64(bins)
    order = np.lexsort((sets, bin_of, owner))
    owner, bin_of, held = owner[order], bin_of[order].astype(np.int64), sets[order]
    place = owner * bins + bin_of
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    out, full = np.zeros(texts * bins, np.uint64), np.zeros(texts * bins, bool)
    out[place[first]], full[place[first]] = held[first], True
    text, slot = np.nonzero(~full.reshape(texts, bins) & (np.diff(at) > 0)[:, None])
    turn = 0
    while len(text):
        turn += 1
        donor = (mixed(slot.astype(np.uint64) + np.uint64(turn * bins)) % np.uint64(bins)).astype(np.int64)
        found = full[text * bins + donor]
        out[text[found] * bins + slot[found]] = out[text[found] * bins + donor[found]]
        text, slot = text[~found], slot[~found]
    return out.reshape(texts, bins)


def described(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, set_key (digest of the shingle set, null if empty), keys (a bucket for each band)."""

    def run(batches):
        for part, data, at in slices(batches, text_col):
            sets, ends = shingle_sets(data, at, words)
            sig = signatures(sets, ends, bands * rows).reshape(-1, bands, rows)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2]).copy()
            for k in range(rows):
                key = mixed(key * np.uint64(31) + sig[:, :, k])
            n = np.diff(ends)
            digests = [digest(sets[ends[i] : ends[i + 1]]) for i in range(len(n))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([values(part, id_col), pa.array(n, pa.int64()), pa.array(digests, pa.string()), lists], names=["id", "n_shingles", "set_key", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_shingles long, set_key string, keys array<long>")


def digest(shingles: np.ndarray) -> str | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """rep, shingles (array of hashes) of the wanted classes (rep, first_id, set_key). A bit filter of fixed size keeps most other rows out before the shuffle."""
    asked = wanted.select("rep", "set_key", F.xxhash64("first_id").alias("h"))
    slot = f"cast(pmod(h, {FILTER_BITS}) as int)"
    bits = asked.select(F.expr(f"cast({slot} / 64 as int)").alias("word"), F.expr(f"shiftleft(1L, {slot} % 64)").alias("bit")).unionByName(docs.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit")))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text")).withColumn("bits", F.element_at(staged(bits, "mh-filter").scalar(), F.expr(f"cast({slot} / 64 as int) + 1")))
    rows = rows.where(F.expr(f"shiftright(bits, {slot} % 64) & 1 = 1")).select("h", "text").join(asked.select("h").distinct(), "h", "left_semi")

    def run(batches):
        for _, data, at in slices(batches, "text"):
            sets, ends = shingle_sets(data, at, words)
            keys = [digest(sets[ends[i] : ends[i + 1]]) for i in range(len(ends) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.LargeListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64))).cast(pa.list_(pa.int64()))], names=["set_key", "shingles"])

    return rows.mapInArrow(run, "set_key string, shingles array<long>").join(asked.select("rep", "set_key"), "set_key").groupBy("rep").agg(F.any_value("shingles").alias("shingles"))


def confirmed(edges: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """The edges a (member), b (hub) whose sets reach the level: 100 * common >= level * all."""
    both = edges.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= level * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def prefix_pairs(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """a, b: every pair of members (rep, n, component) of different components whose sets may reach the level.

    Such sets have c >= level * n / 100 shingles in common, and the smaller one c >= 2 * level * n / (100 + level):
    they share one of their first n - c + 1 in any order of all shingles. Those met in one component only come
    first, as they give no pair; then the rarest. What follows the shared one bounds what two sets have in common.
    """
    held = staged(members.join(sets, "rep").select("rep", "n", "component", F.explode("shingles").alias("shingle")), "mh-rest")
    spread = held.groupBy("shingle").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    spread = staged(spread.select("shingle", "often"), "mh-spread")
    of_rep = Window.partitionBy("rep")
    placed = held.join(spread, "shingle").select("rep", "n", "component", "shingle", (F.col("n") - F.count("*").over(of_rep) + F.row_number().over(of_rep.orderBy("often", "shingle"))).alias("place"))
    first = staged(placed.where(f"place <= n - ceil({level} * n / 100) + 1").withColumn("rest", F.expr("n - place + 1")), "mh-prefixes")
    small = first.where(f"place <= n - ceil(2 * {level} * n / {100 + level}) + 1")
    a, b = (x.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "component", "rest")]) for x, k in ((small, "a"), (first, "b")))
    fits = f"(n_a < n_b or n_a = n_b and rep_a < rep_b) and component_a != component_b and 100 * n_a >= {level} * n_b and 100 * least(rest_a, rest_b) >= {level} * (n_a + n_b - least(rest_a, rest_b))"
    return a.join(b, (a["shingle"] == b["shingle"]) & F.expr(fits)).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, level: int = LEVEL, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Null or empty text, or one without words, is linked with nothing. Repeated rows share a component, as do
    rows that repeat an id where their texts are alike: links are between shingle sets, whatever the
    ids. A null id comes after all others. Ids may be of any type that has an order; other columns are
    ignored; no rows give no rows; texts are read in slices, a very long one in a slice of its own.
    """
    every = staged(described(docs, id_col, text_col, words, bands, rows), "mh-signatures")
    classes = staged(every.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("first_id"), F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys")).withColumn("rep", F.monotonically_increasing_id()), "mh-classes")
    cells = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = staged(cells.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "mh-buckets")
    live = staged(cells.join(shared, "key"), "mh-members")  # members of buckets that hold several classes
    central = staged(live.groupBy("rep").agg(F.sum("size").alias("central")), "mh-central")
    live = staged(live.drop("size").join(central, "rep"), "mh-live")
    hubs = staged(live.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("nrep"), "n")).alias("hub")).select("key", (-F.col("hub.nrep")).alias("hub"), F.col("hub.n").alias("hub_n")), "mh-hubs")
    star = live.join(hubs, "key").where("rep != hub")
    fit = f"100 * least(n, hub_n) >= {level} * greatest(n, hub_n)"
    edges = staged(star.where(fit).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "mh-edges")
    wanted = staged(classes.select("rep", "first_id", "set_key").join(central, "rep", "left_semi"), "mh-wanted")
    sets = staged(full_sets(docs, wanted, id_col, text_col, words), "mh-sets")
    links = staged(confirmed(edges, sets, level), "mh-links")
    found = staged(components(links), "mh-components")
    # All pairs that the stars leave over: of different components in one bucket.
    mine = live.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mine = staged(mine, "mh-placed")
    several = mine.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    rest = staged(mine.join(several, "key").select("rep", "n", "component").distinct(), "mh-open")
    pairs = prefix_pairs(rest, sets, level)
    pairs = pairs.join(edges, ["a", "b"], "left_anti").join(edges.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    new = staged(confirmed(staged(pairs, "mh-edges"), sets, level), "mh-links")
    if not new.isEmpty():
        found = staged(components(links.unionByName(new)), "mh-components")
    found = found.select(F.col("node").alias("rep"), "component")
    named = staged(classes.join(found, "rep").groupBy("component").agg(F.min("first_id").alias("component_id")), "mh-names")
    of_class = classes.select("set_key", "rep", "first_id").join(found, "rep", "left").join(named, "component", "left")
    of_class = staged(of_class.select("set_key", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component")), "mh-class-components")
    some = every.where("set_key is not null").join(of_class, "set_key").select("id", "n_shingles", F.col("component").alias("component_id"))
    none = every.where("set_key is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_oph_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, four-word shingles, similarity of 0.8 or more."""
    return near_duplicates(documents(spark, sf_dir), words=4, level=80)
