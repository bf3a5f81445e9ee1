"""Exact substring dedup: bytes covered by a string of LENGTH bytes that also starts in an earlier document.

1. Rows that repeat an earlier row's whole text are answered at once; only first rows go on.
2. Texts are dealt into groups of about GROUP bytes. Every window of LENGTH bytes is assigned to its
   smallest hash of GRAM bytes; a run of windows with one such anchor, with the bytes they cover, is a
   segment. Equal windows have equal anchors, so only anchors met in two documents matter.
3. Anchors meet in buckets, which tell the text groups what is repeated; the texts then send those
   segments' bytes to the buckets. Like segments are one string with their smallest document.
4. In a bucket the strings of each shared anchor form shards. Their Burrows-Wheeler transforms are merged
   by interleave refinement, and the repeated intervals of LENGTH characters give each window's
   smallest document.
5. The answers go back to the texts, which remove the covered bytes.

What is common to many documents is collapsed where it is found, before each shuffle: an anchor repeated
within a text group sends one mark, a repeated segment one string, and the rest is decided there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mixed, raw, texts
from .bwt import Shard, merge
from .common import documents, staged

LENGTH, GRAM = 50, 24
GROUP = 4 << 20
#: Windows of one segment at most: their answers are the bits of one number.
RUN = 32
#: Strings of a shard.
SHARD = 2048
#: Bits of the filter over repeated rows.
FILTER_BITS = 1 << 20
ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

ANCHORS = [("key", "<u4"), ("bucket", "<u4"), ("text", "<u4"), ("start", "<u4"), ("size", "u1")]
ANSWERS = [("text", "<u4"), ("start", "<u4"), ("mask", "<u4")]


def packed(kinds, columns: dict, pick=slice(None)) -> bytes:
    """Columns one after the other, as bytes."""
    return b"".join(columns[name][pick].astype(kind).tobytes() for name, kind in kinds)


def unpacked(kinds, parts: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in kinds)
    out: dict[str, list] = {name: [] for name, _ in kinds}
    for part in parts:
        n, at = len(part) // width, 0
        for name, kind in kinds:
            out[name].append(np.frombuffer(part, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(v) if v else np.zeros(0, dict(kinds)[name]) for name, v in out.items()}


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, text, start in the text, and number of windows of each segment."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    h = data.astype(np.uint64) + np.uint64(1)
    wide = 1
    for odd in ODD[:4]:
        h = h[:-wide] * odd + h[wide:]
        wide *= 2
        if wide == GRAM - 16:
            eight = h
    n = len(data) - GRAM + 1
    h = mixed(h[:n] * ODD[4] + eight[16 : 16 + n])
    width, size = LENGTH - GRAM + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    h = np.minimum(h[: len(h) - (width - size)], h[width - size :])
    whole = np.ones(len(h), bool)  # windows within one text
    for e in at[1:-1]:
        whole[max(0, e - LENGTH + 1) : e] = False
    cut = np.ones(len(h) + 1, bool)
    cut[1:-1] = (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])
    edge = np.flatnonzero(cut)
    first, size = edge[:-1], np.diff(edge)
    first, size = first[whole[first]], size[whole[first]]
    more = -(-size // RUN)  # long runs are cut
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    first, size = np.repeat(first, more) + nth * RUN, np.minimum(RUN, np.repeat(size, more) - nth * RUN)
    text = np.searchsorted(at, first, "right") - 1
    return h[first], text, first - at[text], size


def ordered(rows: pa.Table) -> tuple[np.ndarray, pa.Table, np.ndarray, np.ndarray]:
    """The texts of a group by document, their documents, bytes and offsets: the same each time."""
    rows = rows.select(["doc", "sha", "text"]).combine_chunks().sort_by([("doc", "ascending"), ("sha", "ascending")])
    data, at = raw(texts(rows.combine_chunks().to_batches()[0], "text")) if rows.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return rows.column("doc").to_numpy(), rows, data, at


def by(value: np.ndarray):
    """The order that sorts `value`, and (value, slice) of each run."""
    order = np.argsort(value, kind="stable")
    v = value[order]
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]])) if len(v) else np.zeros(1, int)
    return order, [(int(v[a]), order[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def find_anchors(groups: int):
    def run(key, rows):
        p = key[0].as_py()
        _, _, data, at = ordered(rows)
        h, text, start, size = segments(data, at)
        order = np.lexsort((text, h))
        h, text, start, size = h[order], text[order], start[order], size[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        last = np.append(edge[1:], len(h)) - 1
        here = np.repeat(text[edge] != text[last], np.diff(np.append(edge, len(h)))) if len(h) else np.zeros(0, bool)  # repeated within the group
        columns = {"key": h & np.uint64(0xFFFFFFFF), "bucket": (h >> np.uint64(32)) % np.uint64(groups), "text": text, "start": start, "size": size}
        alone = {k: v[~here] for k, v in columns.items()}
        marks = np.unique(h[here])
        out: dict[int, list] = {}
        for b, pick in by(alone["bucket"])[1]:
            out[b] = [packed(ANCHORS, alone, pick[np.lexsort((alone["start"][pick], alone["text"][pick]))]), b""]
        for b, pick in by((marks >> np.uint64(32)) % np.uint64(groups))[1]:
            out.setdefault(b, [b"", b""])[1] = (marks[pick] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        known = {k: v[here] for k, v in columns.items()}
        return pa.table({"bucket": pa.array([*out, p], pa.int64()), "p": pa.array([p] * (len(out) + 1), pa.int64()), "anchors": pa.array([*(x[0] for x in out.values()), b""], pa.binary()), "marks": pa.array([*(x[1] for x in out.values()), b""], pa.binary()), "known": pa.array([b""] * len(out) + [packed(ANCHORS, known)], pa.binary())})

    return run


def repeated_anchors(rows):
    """Of a bucket's anchors those that several documents have, dealt by text group."""
    parts, ps = rows.column("anchors").to_pylist(), rows.column("p").to_numpy()
    found = unpacked(ANCHORS, parts)
    p = np.repeat(ps, [len(x) // 17 for x in parts])
    marks = np.unique(unpacked([("key", "<u4")], rows.column("marks").to_pylist())["key"])
    whose = p.astype(np.int64) << 32 | found["text"]
    order = np.lexsort((whose, found["key"]))
    k, w = found["key"][order], whose[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    last = np.append(edge[1:], len(k)) - 1
    shared = (w[edge] != w[last]) | np.isin(k[edge], marks) if len(k) else np.zeros(0, bool)
    pick = order[np.repeat(shared, np.diff(np.append(edge, len(k))))] if len(k) else order
    some = {name: v[pick] for name, v in found.items()}
    out = [(g, packed(ANCHORS, some, own)) for g, own in by(p[pick])[1]]
    out += [(int(g), x) for g, x in zip(ps, rows.column("known").to_pylist(), strict=True) if x]
    return pa.table({"p": pa.array([g for g, _ in out], pa.int64()), "anchors": pa.array([x for _, x in out], pa.binary())})


SENT = "bucket long, p long, keys binary, docs binary, sizes binary, bytes binary, whose binary, answers binary"


def send_segments(key, rows, anchors):
    """The bytes of a text group's repeated segments, each once with its smallest document, dealt by bucket."""
    p = key[0].as_py()
    docs, _, data, at = ordered(rows)
    found = unpacked(ANCHORS, anchors.column("anchors").to_pylist())
    order = np.lexsort((found["start"], found["text"]))
    found = {k: v[order] for k, v in found.items()}
    doc = docs[found["text"].astype(np.int64)]
    first = at[found["text"].astype(np.int64)] + found["start"]
    whole = data.tobytes()
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(whole[a : a + n + LENGTH - 1], len(place)) for a, n in zip(first.tolist(), found["size"].tolist(), strict=True)], np.int64)
    strings = list(place)
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    size, bucket, keys = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
    size[which], bucket[which], keys[which] = found["size"], found["bucket"], found["key"]
    later = doc > least[which]
    mask = (np.uint64(1) << found["size"].astype(np.uint64)) - np.uint64(1)
    sure = {"text": found["text"][later], "start": found["start"][later], "mask": mask[later]}
    ask = np.flatnonzero(~later)
    ask = ask[np.argsort(which[ask], kind="stable")]
    lo, hi = np.searchsorted(which[ask], np.arange(len(strings))), np.searchsorted(which[ask], np.arange(len(strings)), "right")
    out = []
    for b, own in by(bucket)[1]:
        asked = [ask[lo[i] : hi[i]] for i in own]
        rows_of = np.concatenate(asked)
        whose = {"string": np.repeat(np.arange(len(own)), [len(x) for x in asked]), "text": found["text"][rows_of], "start": found["start"][rows_of]}
        own_strings = [strings[i] for i in own]
        out.append((b, p, keys[own].astype("<u4").tobytes(), least[own].astype("<i8").tobytes(), size[own].astype("u1").tobytes(), pa.compress(b"".join(own_strings), codec="zstd", asbytes=True), packed(WHOSE, whose), b""))
    if later.any():
        out.append((p, p, b"", b"", b"", b"", b"", packed(ANSWERS, sure)))
    names = ["bucket", "p", "keys", "docs", "sizes", "bytes", "whose", "answers"]
    return pa.table({name: pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.binary()) for i, name in enumerate(names)})


WHOSE = [("string", "<u4"), ("text", "<u4"), ("start", "<u4")]


def covered_windows(strings: list[bytes], sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each string the bits of its windows that also start in a string of a smaller document."""
    shards, items, of, nth, base = [], [], [], [], 0
    for i in range(0, len(strings), SHARD):
        part = strings[i : i + SHARD]
        at = np.concatenate([[0], np.cumsum([len(s) for s in part])])
        shard = Shard(np.frombuffer(b"".join(part), np.uint8), at)
        n = sizes[i : i + SHARD]
        own = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        items.append(base + shard.rank[shard.begin[own] + k + LENGTH])  # where each window ends
        of.append(i + own)
        nth.append(k)
        shards.append(shard)
        base += len(shard.bwt)
    of, nth = np.concatenate(of), np.concatenate(nth)
    number, block, _ = merge(shards, np.concatenate(items), LENGTH, repeated_only=True)
    mask = np.zeros(len(strings), np.int64)
    if len(number):
        doc = docs[of[number]]
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc, edge), np.diff(np.append(edge, len(doc))))
        gone = number[doc > least]
        mask = np.bincount(of[gone], 2.0 ** nth[gone], minlength=len(strings)).astype(np.int64)
    return mask


def answer(rows):
    """A bucket's answers to its text groups: which windows of which segments go, as the merged transforms of all its strings tell."""
    keys, sizes, docs, strings, asked = [], [], [], [], []
    for r in rows.select(["p", "keys", "docs", "sizes", "bytes", "whose"]).to_pylist():
        size = np.frombuffer(r["sizes"], "u1").astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size + LENGTH - 1)])
        whose = unpacked(WHOSE, [r["whose"]])
        asked.append((r["p"], len(strings) + whose["string"].astype(np.int64), whose["text"], whose["start"]))
        held = pa.decompress(r["bytes"], int(at[-1]), codec="zstd", asbytes=True) if at[-1] else b""
        strings += [held[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        keys.append(np.frombuffer(r["keys"], "<u4"))
        sizes.append(size)
        docs.append(np.frombuffer(r["docs"], "<i8"))
    mask = np.zeros(len(strings), np.int64)
    if strings:
        keys, sizes, docs = np.concatenate(keys), np.concatenate(sizes), np.concatenate(docs)
        _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[where] > 1)  # strings that share their anchor with another one
        if len(some):
            mask[some] = covered_windows([strings[i] for i in some], sizes[some], docs[some])
    out = []
    for p, index, text, start in asked:
        m = mask[index]
        if (hit := m > 0).any():
            out.append((p, packed(ANSWERS, {"text": text, "start": start, "mask": m}, hit)))
    out += [(p, x) for p, x in zip(rows.column("p").to_pylist(), rows.column("answers").to_pylist(), strict=True) if x]
    return pa.table({"p": pa.array([p for p, _ in out], pa.int64()), "answers": pa.array([x for _, x in out], pa.binary())})


def remove(key, rows, answers):
    """doc, sha, n_removed, n_spans, kept_sha256, kept (the bytes left) of each text."""
    _, rows, data, at = ordered(rows)
    found = unpacked(ANSWERS, answers.column("answers").to_pylist())
    first = at[found["text"].astype(np.int64)] + found["start"]
    step = np.zeros(len(data) + 1, np.int64)
    for i in range(RUN):
        hit = first[(found["mask"] >> np.uint32(i)) & np.uint32(1) == 1] + i
        step += np.bincount(hit, minlength=len(step)) - np.bincount(hit + LENGTH, minlength=len(step)) if len(hit) else 0
    gone = np.cumsum(step[:-1]) > 0
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    begin |= gone & np.isin(np.arange(len(gone)), at) if len(gone) else False
    total, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begin)])
    kept = [data[at[i] : at[i + 1]][~gone[at[i] : at[i + 1]]].tobytes() for i in range(len(at) - 1)]
    return pa.table({"doc": rows.column("doc"), "sha": rows.column("sha"), "n_removed": pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), "n_spans": pa.array(spans[at[1:]] - spans[at[:-1]], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]), "kept": pa.array(kept, pa.binary())})


LAST = (1 << 63) - 1


def first_rows(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """doc, sha, text of rows that repeat no earlier row. A filter of fixed size says which rows may be repeats; only those are looked up."""
    slot = f"cast(pmod(xxhash64(doc, sha), {FILTER_BITS}) as int)"
    copies = entries.where("doc > first").select(F.expr(f"cast({slot} / 64 as int)").alias("word"), F.expr(f"shiftleft(1L, {slot} % 64)").alias("bit"))
    every = docs.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
    bits = copies.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    rows = docs.withColumn("maybe", F.element_at(staged(bits, "sd-filter").scalar(), F.expr(f"cast({slot} / 64 as int) + 1")).bitwiseAND(F.expr(f"shiftleft(1L, {slot} % 64)")) != 0)
    own = entries.where("doc = first").select("doc", "sha").distinct()
    sure = rows.where("not maybe").select("doc", "sha", "text")
    return sure.unionByName(rows.where("maybe").select("doc", "sha", "text").join(own, ["doc", "sha"], "left_semi"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256, and the bytes left if asked for.

    Null text counts as empty. A null id comes after all others and never makes another null id's
    bytes go; rows that repeat an id do not either. Texts shorter than a window are left whole.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("sha", F.sha2("text", 256)).select("doc", "sha", "text")
    entries = staged(rows.select("doc", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "sd-rows")
    firsts = staged(entries.groupBy("sha").agg(F.min("doc").alias("first")), "sd-first")
    entries = staged(entries.join(firsts, "sha"), "sd-entries")
    total = entries.agg(F.sum("n_bytes")).first()[0] or 0
    groups = max(1, -(-total // GROUP))
    texts_in = first_rows(rows, entries).withColumn("p", F.pmod(F.xxhash64("sha"), F.lit(groups))).select("p", "doc", "sha", "text")
    anchors = texts_in.groupBy("p").applyInArrow(find_anchors(groups), "bucket long, p long, anchors binary, marks binary, known binary")
    shared = anchors.groupBy("bucket").applyInArrow(repeated_anchors, "p long, anchors binary")
    sent = texts_in.groupBy("p").cogroup(shared.groupBy("p")).applyInArrow(send_segments, SENT)
    answers = sent.groupBy("bucket").applyInArrow(answer, "p long, answers binary")
    done = texts_in.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(remove, "doc long, sha string, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = done if with_text else done.drop("kept")
    done = staged(done.dropDuplicates(["doc", "sha"]), "sd-done")
    own = entries.where("doc = first").join(done, ["doc", "sha"]).select("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
    long = F.col("n_bytes") >= LENGTH
    gone = entries.where("doc > first").join(done.select("sha", F.col("kept_sha256").alias("k"), *[F.col("kept").alias("kb")] * with_text, "doc").withColumnRenamed("doc", "first"), ["sha", "first"])
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    gone = gone.select("doc", "n_bytes", F.when(long, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), F.when(long, 1).otherwise(0).cast("long").alias("n_spans"), F.when(long, empty).otherwise(F.col("k")).alias("kept_sha256"), *[F.when(long, F.lit(b"")).otherwise(F.col("kb")).alias("kept")] * with_text)
    out = own.unionByName(gone)
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias(id_col), *out.columns[1:])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: what repeats 50 bytes of an earlier document."""
    return dedup_substrings(documents(spark, sf_dir))
