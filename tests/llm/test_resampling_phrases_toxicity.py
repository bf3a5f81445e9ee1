"""Importance resampling, phrase collocations and toxicity."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harvestry.llm import collocations, importance, toxicity
from harvestry.llm.registry import oracle_sql, queries

HELD_OUT_SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_collocations"])
def test_matches_sql(name, same_as_sql):
    same_as_sql(queries()[name], oracle_sql()[name])


# ---- resampling


def brute_resample(docs, target, max_n, buckets, least, percent, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        grams = [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, words, f in own:
        n = f.total()
        weight = sum(gain[b] * k for b, k in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    some = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(some[: len(some) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_against_brute_force(spark, max_n):
    rng = random.Random(5)
    words = ["Alpha", "beta", "é", "gamma9", "ß-x", "日本", "q"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (None, "alpha beta " * 30), (7, docs[7][1]), (7, docs[7][1]), (502, "\x00a,B!c\t" * 40), (503, " ".join(rng.choices(words, k=3000)))]
    target = ["beta gamma9 é", None, "", "Alpha 日本"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("kind", F.lit(2)).repartition(3)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(frame, wanted, max_n=max_n, buckets=97, least_words=5, percent=30, seed=3, part=700).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_resample(docs, target, max_n, 97, 5, 30, 3)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    got = importance.resample(some, none, least_words=1, percent=100).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in got} == {(1, 2, 1), (None, 0, None)}


# ---- collocations


def brute_phrases(docs, max_n, least, share, best):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang, p] = (score, a, left, right)

    def hidden(lang, p, a):
        return any(m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= share * a for (m, q), (_, b, _, _) in found.items())

    out = []
    for lang in n:
        kept = [(-s, -a, " ".join(p).encode(), left, r) for (m, p), (s, a, left, r) in found.items() if m == lang and not hidden(lang, p, a)]
        out += [(lang, k + 1, p.decode(), -a, left, r, n[lang], -s) for k, (s, a, p, left, r) in enumerate(sorted(kept)[:best])]
    return sorted(out)


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_phrases_against_brute_force(spark, max_n):
    rng = random.Random(max_n)
    words = ["der", "Die", "das", "é", "日本", "x$y", "UND", "a\x0bb", "z"]
    docs = [(" ".join(rng.choices(words, weights=[9, 5, 3, 2, 2, 1, 4, 1, 1], k=rng.randrange(0, 40))).replace("z", ".,z"), rng.choice(["de", "en", None, "und"])) for _ in range(120)]
    docs += [(None, "de"), ("", None), ("\t one  two\tthree . one two three; one two three? " * 9, "fr"), ("der die das und " * 500, "de")]
    frame = spark.createDataFrame(docs, "text string, lang string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    got = collocations.collocations(frame, max_n=max_n, least=4, best=25, part=300).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(docs, max_n, 4, 50, 25)


def test_phrases_whose_products_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", 1, "a", 3_000_000_000_000), ("en", 1, "b", 2_000_000_000_001), ("en", 2, "a b", 1_999_999_999_999)], "lang string, size int, phrase string, f long")
    got = collocations.scored(counts).collect()
    assert [r.score for r in got] == [1_000_000 * 1_999_999_999_999**2 // (3_000_000_000_000 * 2_000_000_000_001)]


def test_full_filter_loses_no_phrase(spark, monkeypatch):
    docs = [("a b c d e f g " * 12, "en"), ("b c a " * 20, "en")]
    frame = spark.createDataFrame(docs, "text string, lang string")
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    assert sorted(tuple(r) for r in collocations.collocations(frame).collect()) == brute_phrases(docs, 3, 10, 50, 2000)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("one", "en")], "text string, lang string")).count() == 0


# ---- toxicity


def test_toxicity_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries()["op13_toxicity"](spark, HELD_OUT_SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    labels = [(r.toxic, got[r.doc_id]) for r in spark.read.parquet(f"{HELD_OUT_SF}/labels.parquet").collect() if r.toxic is not None]
    held = [(y, r) for y, r in labels if r.held_out]
    assert sum(y == r.predicted for y, r in held) >= 0.95 * len(held) > 0
    assert not any(r.predicted for y, r in held if not y)


def test_toxicity_learns_pairs(spark):
    """Insult a is toxic beside group c and harmless beside d; b the other way round: no sum of single weights tells them apart."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        insult, group = rng.choice(["aa", "bb", ""]), rng.choice(["cc", "dd", ""])
        noise = " ".join(rng.choices(["the", "of", "and", "to"], k=3))
        rows.append((i, f"{noise} {insult} {noise} {group}", int((insult, group) in {("aa", "cc"), ("bb", "dd")})))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs.select("doc_id", "text"), docs.where("doc_id < 900"))
    asked = spark.createDataFrame([(k, f"the of {x} and to {y}") for k, (x, y) in enumerate([("aa", "cc"), ("aa", "dd"), ("bb", "cc"), ("bb", "dd"), ("aa", ""), ("", "dd"), ("", "")])], "doc_id long, text string")
    assert [r.predicted for r in toxicity.scored(asked, machine).orderBy("doc_id").collect()] == [1, 0, 0, 1, 0, 0, 0]


def test_toxicity_edge_cases(spark):
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(["nice words here", "you IDIOT", None, "", "x " * 200_000] * 8)]).withColumn("score", F.lit("s")).withColumn("label", F.lit(9))
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(40)] + [(99, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    assert isinstance(machine, toxicity.Machine)
    got = {r.doc_id: r for r in toxicity.scored(docs, machine).collect()}
    assert len(got) == 40 and got[1].predicted == 1 and got[0].predicted == got[2].predicted == got[4].predicted == 0 and got[2].score == got[3].score
    assert toxicity.fit(docs, labels.limit(0)) == 0 and {r.score for r in toxicity.scored(docs, 0.0).collect()} == {0.0}
    assert toxicity.fit(docs, labels.where("toxic = 1")) == 1
    assert toxicity.scored(docs.limit(0), machine).count() == 0
