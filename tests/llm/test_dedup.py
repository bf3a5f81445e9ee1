"""Exact, near and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import exact_dedup, minhash, suffix_dedup
from harvestry.llm.bwt import Shard, merge
from harvestry.llm.registry import oracle_sql, queries


def docs(spark, rows, extra: str = ""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# ---- exact


def test_exact_dedup_matches_sql(same_as_sql):
    assert same_as_sql(queries()["op9_exact_dedup"], oracle_sql()["op9_exact_dedup"])


def test_exact_dedup_edge_cases(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "c"), (6, "A"), (7, "x" * 300_000)]
    frame = docs(spark, rows).select("doc_id", "text", *[F.lit(9).alias(c) for c in ("id", "digest", "arrival", "n", "bits", "keep_id", "kept")])
    got = {(r.doc_id, r.text_sha256, r.kept): r for r in exact_dedup.dedup(frame, keep="max").collect()}
    group = defaultdict(list)
    for i, t in rows:
        group[t or ""].append(i)
    assert sum(1 for _ in exact_dedup.dedup(frame, keep="max").collect()) == len(rows)
    for (i, sha, _), r in got.items():
        own = next(ids for t, ids in group.items() if hashlib.sha256(t.encode()).hexdigest() == sha)
        assert r.group_size == len(own)
        assert r.keep_id == max((x for x in own if x is not None), default=None)
    kept = exact_dedup.dedup(frame, keep="max").where("kept").groupBy("text_sha256").count().collect()
    assert len(kept) == len(group) and all(r["count"] == 1 for r in kept)
    assert exact_dedup.dedup(docs(spark, [])).count() == 0


def test_exact_dedup_tells_texts_with_one_digest_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same digest"))
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c")])).collect())
    assert got == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]


def entries_of(spark, rows):
    frame = spark.createDataFrame(rows, "text string, id long").select(F.sha2("text", 256).alias("digest"), "id", F.monotonically_increasing_id().alias("arrival"), F.lit(1).cast("long").alias("n"))
    return frame


def test_batches_meet_in_the_index_only_where_filters_say_so(spark):
    rng = random.Random(4)
    batches = [[(f"text {rng.randrange(200)}", 1000 * b + i) for i in range(60)] for b in range(6)]
    index = exact_dedup.Index("min")
    for n, batch in enumerate(batches, 1):
        index.add(entries_of(spark, batch))
        assert [level for level, _, _ in index.runs] == ([0] * n if n < exact_dedup.FAN else [1] + [0] * (n - exact_dedup.FAN))
    every = [x for batch in batches for x in batch]
    want = {hashlib.sha256(t.encode()).hexdigest(): (min(i for u, i in every if u == t), sum(u == t for u, _ in every)) for t, _ in every}
    shared = {t for t, _ in batches[4]} & {t for t, _ in batches[5]}
    crossing = index.runs[1][1].where(index.crossing(0, index.runs[1:])).count()
    assert len(shared) <= crossing < len(shared) + 5 < index.runs[1][1].count()
    asked = spark.createDataFrame([(d,) for d in list(want)[:20]] + [("no such",)], "digest string")
    assert {r.digest: (r.id, r.n) for r in index.find(asked).collect()} == {d: want[d] for d in list(want)[:20]}
    assert {r.digest: (r.id, r.n) for r in index.entries().collect()} == want and len(index.runs) == 1


# ---- near


def shingles(text: str | None, n: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_near(rows, n: int, level: int) -> dict:
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= level * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near(frame, **options) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, **options).collect()}


def test_near_dedup_over_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries()["op6_oph_near_dedup"](spark, sf).collect()}
    assert got == brute_near(rows, 4, 80)


def test_near_dedup_groups_and_edges(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    rows, i = [], 0
    for group in (40, 9, 3, 1):
        base = rng.choices(vocab, k=160)
        for _ in range(group):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(160)] = "edited"
            rows.append((i := i + 1, " ".join(copy)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "two words"), (104, "Two  WORDS"), (105, "x " * 40_000), (106, "x " * 40_001), (107, "été"), (108, "ÉTÉ")]
    frame = docs(spark, rows).withColumn("rep", F.lit(1)).withColumn("set_key", F.lit("z")).withColumn("id", F.lit(5))
    assert near(frame, words=4, level=80) == brute_near(rows, 4, 80)
    assert near(frame) == brute_near(rows, 5, 80)
    assert near(docs(spark, [])) == {}


def test_near_dedup_finds_pairs_among_records_of_one_template(spark):
    rng = random.Random(7)
    template = [f"t{i}" for i in range(200)]

    def changed(words, *at):
        return [f"v{rng.randrange(10**9)}" if k in at else w for k, w in enumerate(words)]

    rows = []
    for i in range(600):  # 173 of 197 shingles of the template: 0.78 to another record
        words = changed(template, 10, 40, 70, 100, 130, 160)
        rows.append((10 * i, " ".join(words)))
        if i % 20 == 0:  # one change in common: 177 of 197, 0.82
            rows.append((10 * i + 5, " ".join(changed(words, 40, 70, 100, 130, 160))))
    want = {i: (len(shingles(t, 4)), i - i % 10, i % 10 == 0) for i, t in rows}
    some = rows[:80]
    assert brute_near(some, 4, 80) == {i: want[i] for i, _ in some}
    assert near(docs(spark, rows), words=4, level=80) == want


def test_near_dedup_repeated_rows_and_null_ids(spark):
    got = minhash.near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_shingle_counts(spark, n):
    rows = [(1, "a b a b a b a b"), (2, "a"), (3, ""), (4, "A a a\x0ba")]
    assert {k: v[0] for k, v in near(docs(spark, rows), words=n).items()} == {i: len(shingles(t, n)) for i, t in rows}


# ---- substrings


def brute_substrings(rows) -> dict:
    """By document: bytes, removed, spans, digest of the bytes left."""
    first: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            first.setdefault(data[i][k : k + 50], i)
    out = {}
    for i, d in data.items():
        gone = [False] * len(d)
        end = 0
        for k in range(len(d) - 49):
            if first[d[k : k + 50]] < i:
                for j in range(max(k, end), k + 50):
                    gone[j] = True
                end = k + 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def by_doc(frame) -> dict:
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


def test_substring_dedup_over_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert by_doc(queries()["op2_suffix_dedup"](spark, sf)) == brute_substrings(rows)


@pytest.mark.parametrize("group", [1 << 22, 4096])
def test_substring_dedup_edges(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefghij é", k=90))
    rows = [(1, line), (2, "x" * 30 + line[:50]), (3, line[20:69] + "tail"), (4, line[20:70] + "tail"), (5, None), (6, ""), (7, line), (8, "short"), (9, "short"), (10, "z" * 500), (11, "z" * 49), (12, "q" + "z" * 700)]
    rows += [(20 + i, "".join(rng.choices("ab", k=300)) + line + "".join(rng.choices("cd", k=rng.randrange(200)))) for i in range(20)]
    rows += [(60, "".join(rng.choices("efgh ", k=70_000))), (61, rows[-1][1] * 2), (62, line[::-1] + line[::-1])]
    frame = docs(spark, rows).withColumn("p", F.lit(1)).withColumn("sha", F.lit("s")).withColumn("doc", F.lit(0))
    assert by_doc(suffix_dedup.dedup_substrings(frame)) == brute_substrings(rows)
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_substrings(frame, with_text=True).collect()}
    assert kept[2] == b"x" * 30 and kept[7] == b"" and kept[1] == line.encode()


def test_substring_dedup_of_nothing(spark):
    assert suffix_dedup.dedup_substrings(docs(spark, [])).count() == 0
    assert by_doc(suffix_dedup.dedup_substrings(docs(spark, [(1, None)]))) == brute_substrings([(1, None)])


def test_merged_transforms_give_the_order_of_all_contexts():
    rng = random.Random(1)
    parts = [["".join(rng.choices("ab", k=rng.randrange(1, 30))) for _ in range(6)] for _ in range(3)]
    shards, contexts = [], []
    for strings in parts:
        raw = [s.encode() for s in strings]
        shard = Shard(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        own = [""] * len(shard.bwt)
        for s, begin in zip(strings, shard.begin, strict=True):
            whole = s + "\0"  # a context: the ten characters before a suffix, round the string's end
            for k in range(len(whole)):
                own[shard.rank[begin + k]] = "".join(whole[(k - 10 + j) % len(whole)] for j in range(10))
        shards.append(shard)
        contexts += own
    number, block, common = merge(shards, depth=10)
    order = [contexts[k] for k in number]
    assert order == sorted(contexts)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        assert common[k] == next((j for j in range(10) if a[j] != b[j]), 10)
        assert (block[k] == block[k - 1]) == (a == b)
