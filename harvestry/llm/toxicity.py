"""Toxicity: a factorization machine over hashed terms.

Terms are words and their first bytes (stems), hashed to SLOTS numbers; a term's value is log(1 + its
occurrences). The machine adds to the linear weights the products of each two terms' vectors, so that an insult
beside the mention of a group can weigh more, or less, than the two alone. It is fitted on a bounded
sample of labelled rows: Spark counts in how many rows of each label each slot occurs, slots whose
occurrence depends on the label (a G test) become features, and rows with features only, a few numbers each,
go to the driver. Scoring passes over all other terms of a text before it counts any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import mixed, slices, values
from .common import documents, staged
from .shingles import powers

SLOTS = 1 << 18
#: Bytes at the start of a word that are a term of their own if the word is longer.
STEMS = (4, 5, 6, 7)
#: Labelled rows that the machine is fitted on, at most (those with the smallest hash of their id).
FIT_ROWS = 20_000
#: Slots that become features: at most so many, with this G at least, or the first FEW of all.
FEATURES, LEAST_G, FEW = 4096, 10.0, 16
FACTORS, EPOCHS, RATE, SHRINK, BATCH = 4, 40, 0.3, 1e-4, 256
CUT = 0.5


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text number of each term: runs of letters, digits and bytes from 128 on, A-Z as a-z, and their stems."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    wordy = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts, ends = wordy.copy(), wordy.copy()
    starts[1:] &= ~wordy[:-1] | edge[1:-1]
    ends[:-1] &= ~wordy[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    text = np.searchsorted(at, s, "right") - 1
    slots, whose = [], []
    for kind, size in enumerate((0, *STEMS)):
        some = e - s > size if size else np.ones(len(s), bool)
        end = s[some] + size if size else e
        h = (total[end] - total[s[some]]) * down[s[some]] + np.uint64(kind * 0x632BE59BD9B4E019 % (1 << 64))
        slots.append((mixed(h) % np.uint64(SLOTS)).astype(np.int64))
        whose.append(text[some])
    return np.concatenate(slots), np.concatenate(whose)


def valued(slot: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and value of each different term, in the order of texts."""
    key, n = np.unique(whose * SLOTS + slot, return_counts=True)
    return key // SLOTS, key % SLOTS, np.log1p(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Staged: text, label (0 or 1) of at most `rows` rows of `labels` whose label is not null."""
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("tox_id"), F.col(label_col).cast("int").alias("label"))
    sample = sample.orderBy(F.xxhash64("tox_id"), "tox_id", "label").limit(rows)
    return staged(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(sample), F.col(id_col) == F.col("tox_id")).select(F.col("tox_id").alias("id"), "text", "label"), "toxicity-sample")


def slot_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rows of label 1 and all rows that have each slot; rows of label 1 and all rows. The driver gets SLOTS rows at most."""

    def run(batches):
        table = np.zeros((2, SLOTS + 1), np.int64)  # the last counts rows
        for rows, data, at in slices(batches, "text"):
            label = values(rows, "label").to_numpy(zero_copy_only=False).astype(np.int64)
            text, slot, _ = valued(*terms(data, at))
            for k in (0, 1):
                table[k, :-1] += np.bincount(slot[label[text] == k], minlength=SLOTS)
                table[k, -1] += int((label == k).sum())
        some = np.flatnonzero(table.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[0, some]), pa.array(table[1, some])], names=["slot", "clean", "toxic"])

    sums = sample.select("text", "label").mapInArrow(run, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = sums.toArrow()
    table = np.zeros((2, SLOTS + 1), np.int64)
    for k, name in enumerate(("clean", "toxic")):
        table[k, got["slot"].to_numpy()] = got[name].to_numpy()
    return table[1, :-1], table.sum(0)[:-1], int(table[1, -1]), int(table[:, -1].sum())


def telling(toxic: np.ndarray, rows: np.ndarray, all_toxic: int, all_rows: int) -> np.ndarray:
    """The slots whose occurrence depends most on the label: a G test of each."""
    a, t, p, n = toxic.astype(float), rows.astype(float), float(all_toxic), float(all_rows)

    def part(seen, wanted):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(wanted, 1e-12)), 0.0)

    g = 2 * (part(a, t * p / n) + part(t - a, t * (n - p) / n) + part(p - a, (n - t) * p / n) + part(n - p - t + a, (n - t) * (n - p) / n))
    order = np.argsort(-g, kind="stable")[:FEATURES]
    strong = order[g[order] >= LEAST_G]
    return np.sort(strong if len(strong) >= FEW else order[:FEW][rows[order[:FEW]] > 0])


class Machine:
    """score = sigmoid(bias + sum w x + sum over pairs <v_i, v_j> x_i x_j), fitted by AdaGrad over shuffled parts; the same rows give the same machine."""

    def __init__(self, slots: np.ndarray, text: np.ndarray, feature: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, m = len(y), len(slots)
        self.slots = slots
        self.w, self.v = np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))
        share = (y.sum() + 0.5) / (n + 1)
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v = np.full(m, 1e-8), np.full((m, FACTORS), 1e-8)
        at = np.searchsorted(text, np.arange(n + 1))
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
                long = at[part + 1] - at[part]
                own = np.repeat(np.arange(len(part)), long)
                where = np.arange(long.sum()) + np.repeat(at[part] - np.concatenate([[0], np.cumsum(long)[:-1]]), long)
                f, value = feature[where], x[where]
                raw, pooled = self.raw(own, f, value, len(part))
                d = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[part]) / len(part)
                grad_w = np.bincount(f, d[own] * value, minlength=m) + SHRINK * self.w
                pull = d[own, None] * (value[:, None] * pooled[own] - self.v[f] * (value * value)[:, None])
                grad_v = np.stack([np.bincount(f, pull[:, j], minlength=m) for j in range(FACTORS)], 1) + SHRINK * self.v
                seen_w += grad_w * grad_w
                seen_v += grad_v * grad_v
                self.w -= RATE * grad_w / np.sqrt(seen_w)
                self.v -= RATE * grad_v / np.sqrt(seen_v)
                self.bias -= 0.05 * float(d.sum())

    def raw(self, own: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's sum for each of n texts, and the sum of its terms' vectors."""
        vx = self.v[f] * x[:, None]
        pooled = np.stack([np.bincount(own, vx[:, j], minlength=n) for j in range(FACTORS)], 1)
        pairs = 0.5 * ((pooled * pooled).sum(1) - np.bincount(own, (vx * vx).sum(1), minlength=n))
        return self.bias + np.bincount(own, self.w[f] * x, minlength=n) + pairs, pooled

    def score(self, data: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """place: the feature of each slot, or -1."""
        slot, whose = terms(data, at)
        some = place[slot] >= 0
        own, slot, x = valued(slot[some], whose[some])
        raw, _ = self.raw(own, place[slot], x, len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    def places(self) -> np.ndarray:
        place = np.full(SLOTS, -1)
        place[self.slots] = np.arange(len(self.slots))
        return place


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Machine | float:
    """The machine; if the labels are not of two classes, the share of label 1 (0 without labels)."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, rows)
    toxic, seen, all_toxic, all_rows = slot_counts(sample)
    if not 0 < all_toxic < all_rows:
        return all_toxic / max(1, all_rows)
    slots = telling(toxic, seen, all_toxic, all_rows)
    place = np.full(SLOTS, -1)
    place[slots] = np.arange(len(slots))

    def run(batches):
        for part, data, at in slices(batches, "text"):
            slot, whose = terms(data, at)
            some = place[slot] >= 0
            own, slot, x = valued(slot[some], whose[some])
            cuts = np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (place[slot].astype(np.int32), x)]
            yield pa.RecordBatch.from_arrays([values(part, "id"), values(part, "label"), *lists], names=["id", "label", "f", "x"])

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"id {kind}, label int, f array<int>, x array<double>").orderBy("id", "label").toArrow()  # FIT_ROWS rows of FEATURES numbers at most
    f, x = got["f"].combine_chunks(), got["x"].combine_chunks()
    long = np.diff(f.offsets.to_numpy())
    return Machine(slots, np.repeat(np.arange(len(got)), long), f.flatten().to_numpy(), x.flatten().to_numpy(), got["label"].to_numpy().astype(float))


def scored(docs: DataFrame, machine: Machine | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted. Null text counts as empty; repeated rows score alike; no rows give none; other columns are ignored. A very long text is a slice of its own."""
    if not isinstance(machine, Machine):
        return docs.select(id_col, F.lit(float(machine)).alias("score"), F.lit(int(machine >= CUT)).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(machine)  # FEATURES * (FACTORS + 2) numbers at most

    def run(batches):
        place = held.value.places()
        for rows, data, at in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([values(rows, id_col), pa.array(held.value.score(data, at, place))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, scored for toxicity; labels of held-out rows are never seen."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return scored(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
