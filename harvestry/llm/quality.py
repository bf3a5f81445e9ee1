"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

Word vectors come from all texts: every word (hashed to one of CELLS) adds up the sparse ternary index
vectors of the words around it. Each task sums its own table; the tables, of fixed size, are added in two
steps. A document is pooled to the mean of its words' vectors, the mean products of vectors one and two
words apart (large where words repeat), and the mean index vectors of word shapes. The network is fitted
on a bounded sample of labelled rows, and a temperature on a part of it that the fit has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import mixed, slices, values
from .common import documents
from .shingles import powers

CELLS, DIMS, NONZERO, WINDOW = 1 << 13, 32, 4, 2
SHAPES = 5
#: Labelled rows that the network is fitted on, at most (those with the smallest hash of their id).
FIT_ROWS = 20_000
HIDDEN, EPOCHS, RATE = 24, 80, 0.01
CUT = 0.3
#: Blocks of the table of word vectors, and partial sums of each.
BLOCKS, PARTIAL = 64, 16


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, text and shape of each run of letters and digits and each run of other signs; A-Z as a-z in the cell.

    Shapes: 0 no capital, 1 capitals only, 2 mixed, 3 with a digit, 4 signs.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    wordy = upper | digit | ((data >= 97) & (data <= 122)) | (data >= 128)
    kind = np.where((data == 32) | ((data >= 9) & (data <= 13)), 0, np.where(wordy, 1, 2))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = edge[-1] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    cut = np.flatnonzero(edge)
    s, e = cut[:-1], cut[1:]
    some = kind[s] > 0
    s, e = s[some], e[some]
    low = np.where(upper, data + 32, data).astype(np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low + np.uint64(1)) * up[: len(data)], out=total[1:])
    cell = (mixed((total[e] - total[s]) * down[s]) % np.uint64(CELLS)).astype(np.int64)
    run = np.concatenate([[0], np.cumsum(upper)])
    capitals = run[e] - run[s]
    run = np.concatenate([[0], np.cumsum(digit)])
    digits = run[e] - run[s]
    shape = np.where(kind[s] == 2, 4, np.where(digits > 0, 3, np.where(capitals == 0, 0, np.where((capitals == e - s) & (e - s > 1), 1, 2))))
    return cell, np.searchsorted(at, s, "right") - 1, shape


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places (CELLS x NONZERO) and signs of the sparse index vectors."""
    h = mixed(np.arange(CELLS * NONZERO, dtype=np.uint64) + np.uint64(12345)).reshape(CELLS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def added(parts: DataFrame) -> DataFrame:
    def run(rows):
        table = sum((np.frombuffer(x, "<i8") for x in rows.column("table").to_pylist()), np.zeros(CELLS // BLOCKS * (DIMS + 1), np.int64))
        return pa.table({"block": rows.column("block").slice(0, 1), "part": pa.array([0], pa.int32()), "table": pa.array([table.tobytes()], pa.binary())})

    schema = "block int, part int, table binary"
    return parts.groupBy("block", "part").applyInArrow(run, schema).groupBy("block").applyInArrow(run, schema)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """CELLS x DIMS unit vectors from the contexts of all words of all texts; the driver gets this table only."""

    def run(batches):
        table = np.zeros((CELLS, DIMS + 1), np.int64)  # the last column counts
        place, sign = index_vectors()
        seen = 0
        for _, data, at in slices(batches, text_col):
            cell, text, _ = tokens(data, at)
            seen += len(cell) and int(cell.sum())
            table[:, DIMS] += np.bincount(cell, minlength=CELLS)
            for gap in range(1, WINDOW + 1):
                same = text[gap:] == text[:-gap]
                a, b = cell[:-gap][same], cell[gap:][same]
                for word, other in ((a, b), (b, a)):
                    for j in range(NONZERO):
                        table[:, :DIMS] += np.bincount(word * DIMS + place[other, j], sign[other, j], minlength=CELLS * DIMS).astype(np.int64).reshape(CELLS, DIMS)
        parts = table.reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([seen % PARTIAL] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "part", "table"])

    rows = added(docs.select(text_col).mapInArrow(run, "block int, part int, table binary")).collect()  # BLOCKS rows of fixed size
    table = np.zeros((BLOCKS, CELLS // BLOCKS * (DIMS + 1)))
    for r in rows:
        table[r["block"]] = np.frombuffer(r["table"], "<i8")
    table = table.reshape(CELLS, DIMS + 1)
    context, n = table[:, :DIMS], table[:, DIMS:]
    context = context - n * (context.sum(0) / max(1.0, n.sum()))
    return (context / np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))).astype(np.float32)


def pooled(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of 3 * DIMS + SHAPES numbers per text; zeros for a text without words."""
    cell, text, shape = tokens(data, at)
    n = len(at) - 1
    out = np.zeros((n, 3 * DIMS + SHAPES), np.float64)
    if not len(cell):
        return out
    many = np.bincount(text, minlength=n)
    v = vectors[cell]
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    own = text[first]
    out[own, :DIMS] = np.add.reduceat(v, first, axis=0)
    for gap in (1, 2):
        product = np.zeros_like(v)
        product[:-gap] = v[:-gap] * v[gap:] * (text[gap:] == text[:-gap])[:, None]
        out[own, gap * DIMS : (gap + 1) * DIMS] = np.add.reduceat(product, first, axis=0)
    out[:, 3 * DIMS :] = np.bincount(text * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    return out / np.maximum(1, many)[:, None]


class Network:
    """Two layers, fitted by full passes of Adam over shuffled parts; the same data give the same network."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held = order[: len(x) // 5]
        fit = order[len(x) // 5 :]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
        m, s, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        z = (x - self.mean) / self.scale
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
                h = np.tanh(z[part] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-(h @ w[2] + w[3])))
                d = (p - y[part]) / len(part)
                back = d[:, None] * w[2] * (1 - h * h)
                grads = [z[part].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], d.sum()]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(held):
            logit, truth = self.logit(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            self.temperature = float(min(grid, key=lambda t: np.mean(np.logaddexp(0, logit / t) - truth * logit / t)))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def pool(docs: DataFrame, vectors: np.ndarray, id_col: str, text_col: str, network: Network | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, carry, and the pooled numbers, or, given a network, its score."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))  # of fixed size

    def run(batches):
        table, net = held.value
        for rows, data, at in slices(batches, text_col, 1 << 20):
            x = pooled(data, at, table)
            last = pa.array(net.score(x)) if net else pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(values(rows, c) for c in (id_col, *carry)), last], names=[id_col, *carry, "out"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry))
    return docs.select(id_col, *carry, text_col).mapInArrow(run, f"{kinds}, out {'double' if network else 'array<double>'}")


def fit(docs: DataFrame, labelled: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Network | None:
    """The network, fitted on at most `rows` rows of `labelled` (id_col, label_col; null labels are passed over). None if there are no two classes."""
    sample = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label_col).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    got = pool(docs.join(F.broadcast(sample), id_col), vectors, id_col, text_col, carry=(label_col,)).collect()  # FIT_ROWS rows at most
    got.sort(key=lambda r: r[id_col])
    y = np.array([float(r[label_col]) for r in got])
    return Network(np.array([r["out"] for r in got]), y) if len(set(y)) > 1 else None


def scored(docs: DataFrame, vectors: np.ndarray, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted. Null text counts as empty; without a network every score is 0.5. Repeated rows score alike."""
    if network is None:
        return docs.select(id_col, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    return pool(docs, vectors, id_col, text_col, network).select(id_col, F.col("out").alias("score"), F.when(F.col("out") >= CUT, 1).otherwise(0).alias("predicted"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, scored for quality; labels of held-out rows are never seen."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    vectors = word_vectors(docs)
    network = fit(docs.select("doc_id", "text"), labels, vectors)
    return scored(docs, vectors, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
