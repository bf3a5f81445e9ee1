"""Language identification by bit-sliced Bloom filters over n-grams.

Training counts letter n-grams per language over all labelled rows and keeps those that make up at
least 1 / `kept` of their language's n-grams: `kept` of a language at most, however large the corpus,
so that chance n-grams (names, typing errors) of a large corpus don't fill the filters. The filters of all languages share their hash functions and are stored bit-sliced: a table slot is
a bitmask of languages, so the AND of an n-gram's slots names every language that has it. A
document's n-grams are looked up, set bits counted per language, counts corrected by each filter's
false positive rate, and the largest corrected count decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import mixed, slices, values
from .common import documents, staged

#: Letters of an n-gram; the edge of a word counts as a letter.
SIZES = (3, 4)
#: n-grams of a language kept at most, unless `learn` is told otherwise.
GRAMS = 12_000
#: Bytes of text whose n-grams are held at once.
PART = 1 << 19
#: n-grams counted in a task before their sums are passed on.
HELD = 500_000
#: Slots of the bit-sliced table and hash functions.
SLOTS, HASHES = 1 << 18, 3

_letter: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter[0]


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, the text that each belongs to, and the letters of each text."""
    parts = [data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace").lower() for i in range(len(at) - 1)]
    sizes = np.array([len(p) + 1 for p in parts])
    code = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(parts)), sizes)
    is_letter = letter_table()[code]
    letters = np.bincount(owner[is_letter], minlength=len(parts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one edge after each word
    code = np.where(is_letter, code, 0)[keep].astype(np.uint64)
    owner = owner[keep]
    found, whose = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k : len(code) - n + 1 + k]
        same = owner[: len(h)] == owner[n - 1 :]
        for k in range(1, n - 1):
            same &= code[k : len(code) - n + 1 + k] != 0  # no edge inside
        found.append(mixed(h[same]))
        whose.append(owner[: len(h)][same])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    return np.concatenate(found), np.concatenate(whose), letters


def counted(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, n: sums of each task's n-grams."""

    def run(batches):
        held: dict[str, list] = {}

        def emit():
            for lang, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for rows, data, at in slices(batches, text_col, PART):
            h, whose, _ = grams(data, at)
            langs = np.array(values(rows, lang_col).to_pylist(), object)
            for lang in set(langs.tolist()):
                gram, n = np.unique(h[(langs == lang)[whose]], return_counts=True)
                if lang in held:
                    both, where = np.unique(np.concatenate([held[lang][0], gram]), return_inverse=True)
                    gram, n = both, np.bincount(where, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = [gram, n]
            if sum(len(g) for g, _ in held.values()) > HELD:
                yield from emit()
        yield from emit()

    return docs.select(text_col, lang_col).mapInArrow(run, "lang string, gram long, n long")


class Filters:
    """Bit-sliced Bloom filters of some languages."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int]], prior: str | None):
        self.langs, self.prior = langs, prior
        self.table = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64)
        place = {x: i for i, x in enumerate(langs)}
        gram = np.array([g for _, g in rows], np.int64).view(np.uint64)
        lang = np.array([place[x] for x, _ in rows], np.int64)
        for at in self.slots(gram):
            np.bitwise_or.at(self.table, (lang // 64, at), np.uint64(1) << (lang % 64).astype(np.uint64))
        fill = np.array([((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false = fill**HASHES  # false positive rate of each language's filter

    @staticmethod
    def slots(gram: np.ndarray):
        step = (gram >> np.uint64(40)) | np.uint64(1)
        for k in range(HASHES):
            yield ((gram + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64)

    def counts(self, gram: np.ndarray, whose: np.ndarray, texts: int) -> np.ndarray:
        """n-grams of each text in each language, corrected for false positives."""
        total = np.bincount(whose, minlength=texts)
        out = np.zeros((texts, len(self.langs)))
        at = list(self.slots(gram))
        for w, words in enumerate(self.table):
            mask = words[at[0]]
            for other in at[1:]:
                mask &= words[other]
            for i in range(64 * w, min(64 * (w + 1), len(self.langs))):
                bit = (mask >> np.uint64(i % 64)) & np.uint64(1)
                hits = np.bincount(whose[bit.astype(bool)], minlength=texts)
                out[:, i] = np.maximum(0, (hits - total * self.false[i]) / (1 - self.false[i]))
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", kept: int = GRAMS) -> Filters:
    """The filters of all languages of `docs`; rows of null language are passed over, null text counts as empty.

    Repeated rows count again; other columns are ignored. `kept` bounds what the driver gathers: that many
    n-grams of each language.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    sums = staged(counted(known, text_col, lang_col).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    totals = staged(sums.groupBy("lang").agg(F.sum("n").alias("total")), "lang-totals")
    rows = sums.join(totals, "lang").where(F.col("n") * kept >= F.col("total")).select("lang", "gram").collect()  # `kept` of each language at most
    names = [r["lang"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    return Filters(sorted(names), [(r["lang"], r["gram"]) for r in rows], names[0] if names else None)


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry`, lang_pred, score (share of the decided language in all counts), coverage (part of the n-grams that it has), n_grams.

    A text without letters, or null, is `und` with score 0; letters that no filter knows are the most
    frequent language with score 0. Ties go to the first name. Without learned languages all is `und`.
    Repeated rows get the same answer each; columns not in `carry` are left out, and those in it may have
    any name but the four that are added. Texts are read in slices: a very long one is a slice of its own.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)  # fixed size: SLOTS words per 64 languages

    def run(batches):
        model = held.value
        for rows, data, at in slices(batches, text_col, PART):
            gram, whose, letters = grams(data, at)
            n = rows.num_rows
            counts = model.counts(gram, whose, n) if model.langs else np.zeros((n, 1))
            best = counts.argmax(1)
            top, total = counts[np.arange(n), best], counts.sum(1)
            names = np.array([*model.langs, "und"], object)
            pick = np.where((letters == 0) | (not model.langs), len(names) - 1, best)
            if model.langs:
                pick = np.where((letters > 0) & (total <= 0), model.langs.index(model.prior), pick)
            some = (letters > 0) & (total > 0)
            score = np.where(some, top / np.maximum(total, 1e-9), 0.0)
            cover = np.where(some, np.minimum(1, top / np.maximum(np.bincount(whose, minlength=n), 1)), 0.0)
            many = pa.array(np.bincount(whose, minlength=n), pa.int64())
            yield pa.RecordBatch.from_arrays([*(values(rows, c) for c in carry), pa.array(names[pick], pa.string()), pa.array(score), pa.array(cover), many], names=[*carry, "lang_pred", "score", "coverage", "n_grams"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, text_col).mapInArrow(run, f"{kinds}, lang_pred string, score double, coverage double, n_grams long")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op3_language_bloom(spark, sf_dir: str) -> DataFrame:
    """All documents; learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    filters = learn(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang"))
    return identify(docs, filters).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")
