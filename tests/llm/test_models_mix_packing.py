"""Language, quality, mixing, packing, and the corpus pipeline."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import language, mixing, packing, quality
from harvestry.llm.registry import queries

HELD_OUT_SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


# ---- language


def test_language_on_held_out_documents(spark):
    got = queries()["op3_language_bloom"](spark, HELD_OUT_SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{HELD_OUT_SF}/documents.parquet").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und" and lang[r.doc_id] is not None]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) > 0


def test_language_edge_cases(spark):
    taught = table(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("nobody", None), (None, "en")] * 5)])
    asked = table(spark, [(1, None, None, None), (2, "", None, None), (3, "123 !?", None, None), (4, "the dog", None, None), (5, "die Katze " * 50_000, None, None), (6, "ξψω", None, None), (6, "ξψω", None, None)]).withColumn("score", F.lit("x"))
    got = sorted((r.doc_id, r.lang_pred) for r in language.identify(asked, language.learn(taught)).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "en"), (6, "en")]
    none = language.learn(taught.limit(0))
    assert {r.lang_pred for r in language.identify(asked, none).collect()} == {"und"}
    assert language.identify(asked.limit(0), language.learn(taught)).count() == 0


# ---- quality


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries()["op8_quality"](spark, HELD_OUT_SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{HELD_OUT_SF}/labels.parquet").collect() if r.quality is not None and r.doc_id in got and got[r.doc_id].held_out]
    pairs = [(got[i].score, got[j].score) for i, x in labels if x == 1 for j, y in labels if y == 0]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) >= 0.8 * len(pairs) > 0


def test_quality_edge_cases(spark):
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(["good words here", "BAD!!! 000", None, "", "x " * 200_000] * 8)]).withColumn("out", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)] + [(99, 1), (3, None)], "doc_id long, quality int")
    vectors = quality.word_vectors(docs)
    assert vectors.shape == (quality.CELLS, quality.DIMS) and np.isfinite(vectors).all()
    got = {r.doc_id: r.score for r in quality.scored(docs, vectors, quality.fit(docs, labels, vectors)).collect()}
    assert len(got) == 40 and got[0] > got[1] and got[2] == got[3]
    assert {r.score for r in quality.scored(docs, vectors, None).collect()} == {0.5}
    assert quality.fit(docs, labels.limit(0), vectors) is None
    assert quality.word_vectors(docs.limit(0)).shape == vectors.shape


# ---- mixing


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


def check_mix(rows, texts: dict, sources: dict, words: int) -> None:
    """Each source misses its target by at most `words`."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    by_source: Counter = Counter()
    for i, s in sources.items():
        by_source[s] += size[i]
    target, taken = brute_targets(by_source), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        s = sources[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == by_source[s] and abs(r.target - target[s]) <= 1e-5 * max(1, target[s])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in by_source:
        assert abs(taken[s] - target[s]) <= words, (s, taken[s], target[s])


def test_mix_over_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first, again = (sorted(queries()["op4_pareto_mix"](spark, sf).collect()) for _ in range(2))
    assert first == again
    check_mix(first, {r.doc_id: r.text for r in docs}, {r.doc_id: r.source for r in docs}, 60)


def test_mix_edge_cases(spark):
    rows = [(i, "w " * (i % 17), None, [None, "", "b", "a"][i % 4]) for i in range(400)] + [(1000, None, None, "empty"), (1001, "one", None, "tiny")]
    frame = table(spark, rows).withColumn("g", F.lit(1)).withColumn("q", F.lit(2)).withColumn("row", F.lit(0))
    check_mix(mixing.mix(frame).collect(), {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}, 2)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mix_takes_longer_documents_more_often(spark):
    """Twenty sources alike, a third of each to be sampled beside a certain copy: how often a size is taken follows its inclusion probability."""
    sizes = [4, 9, 16, 25, 36, 64, 100, 144] * 50
    rows = [(1000 * s + k, "w " * n, None, f"s{s:03d}") for s in range(40) for k, n in enumerate(sizes)]
    got = mixing.mix(table(spark, rows), weights=(2.0, 1.0)).where("target > source_size").collect()
    by_size: dict = defaultdict(list)
    for r in got:
        assert r.copies in (1, 2)
        by_size[r["size"]].append((r.copies - 1, r.p))
    c = (1 / 3) * sum(sizes) / sum(n**1.5 for n in sizes)  # none of the sizes is certain
    for n, own in by_size.items():
        assert abs(own[0][1] - c * n**0.5) < 1e-6 and abs(np.mean([t for t, _ in own]) - c * n**0.5) < 0.06, n
    assert np.mean([t for t, _ in by_size[144]]) > 2.5 * np.mean([t for t, _ in by_size[4]])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_with_heavy_tails(spark, seed):
    """A few documents hold most words of a source: small ones make up what the large ones leave open, to the last that fits."""
    shapes = {"a": [10] * 8000 + [30_000] * 3, "b": [10] * 3000 + [1500] * 60, "c": [7] * 50_000, "d": [40_000] * 2 + [3] * 30_000, "e": [5000, 4000, 2500, 1200, 700, 330, 150, 90, 40, 20] * 3}
    rows = [(k, "w " * n, None, s) for k, (s, n) in enumerate((s, n) for s, own in shapes.items() for n in own)]
    got = mixing.mix(table(spark, rows), weights=(4.0, 2.0, 5.0), seed=seed).collect()
    taken, target = Counter(), {}
    for r in got:
        assert r.copies <= 3
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= min(own) for s, own in shapes.items()), [(s, taken[s], target[s]) for s in shapes]


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(None, "w " * (5 + i % 3), None, "a") for i in range(2000)] + [(7, "x y z", None, "b")] * 900 + [(i, f"one two {i}", None, "c") for i in range(3000)]
    got = mixing.mix(table(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 6 for s in "abc")


# ---- packing


def test_encoder_has_the_ids_of_whole_texts():
    rng = np.random.default_rng(3)
    encoder = packing.Encoder(packing.default_tokenizer())
    signs = list("aAbİ'.,! \ńéK1½s 二#</w>|")
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 60, 2000)] + ["İ<", "don't. a'll. ''s", "KELVIN K. ΟΔΟΣ.", "</w> a</w>. <|endoftext|>.", "", "\n\n"]
    for text in texts:
        parts = text.encode().replace(b"\n", b" ").split(b" ")
        encoder.learn(set(parts))
        assert b"".join(encoder.parts[p] for p in parts) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def encoded(encoder, texts: list[bytes]) -> list[list[int]]:
    at = np.append(0, np.cumsum(list(map(len, texts)))).astype(np.int64)
    ids, ids_at = encoder.blocks(np.frombuffer(b"".join(texts), np.uint8), at)
    return [ids[i:j].tolist() for i, j in zip(ids_at, ids_at[1:], strict=False)]


def test_cuts_within_texts_change_no_ids(monkeypatch):
    """Texts one after the other, also in blocks and with a table that is always full and at times emptied."""
    rng = np.random.default_rng(5)
    encoder = packing.Encoder(packing.default_tokenizer())
    signs = [*"aAbstSreé\u0301İKΣЖßçÉ\u0307'.,!-  \n\t\r19½²二#|><", "'ll", "'RE", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "</w>", "\u2019s", "\x00", "\x85"]
    texts = ["".join(signs[i] for i in rng.integers(0, len(signs), n)) for n in rng.integers(0, 60, 3000)]
    texts += [f"{chr(c)}{tail}" for c in (*range(0xC0, 0x180), *range(0x400, 0x480)) for tail in (",", "'s a", "1", "\u0301,")]
    texts += [f"{a}{chr(b)}{tail}" for a in "HJTWYhjtwyKA" for b in range(0x300, 0x340) for tail in ("", ".")]  # some marks make one letter with the small one only
    texts += ["", " ", "\n"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    data = [t.encode() for t in texts]
    assert encoded(encoder, data) == want
    broken = [b"a\xc3", b"\xa9,b \xe2\x82,c", b"\xc3", b"\xa9", b"<|endof", b"text|>"]
    assert encoded(encoder, broken) == [encoder.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]
    assert encoded(encoder, [b"", b"", b" "]) == [[], [], []] and encoded(encoder, [b""]) == [[]]
    monkeypatch.setattr(packing, "PARTS", 50)
    monkeypatch.setattr(packing, "TEXT", 10)
    for t, w in zip(data, want, strict=True):
        assert encoded(encoder, [t]) == [w], t
        assert len(encoder.parts) <= 50


def test_equal_words_are_encoded_once_whatever_is_beside_them():
    """A word with a capital, a sign, a number or an ending has no entry of its own: the tokenizer's work grows with the different words."""
    encoder = packing.Encoder(packing.default_tokenizer())
    words = ["alpha", "Beta", "GAMMA", "été", "straße", "слово"]
    text = " ".join(f"{a}{w}{b}" for w in words for a in ("", "(", "12", "#") for b in ("", ",", ".", "!!", ");", "7", "'s", "-42", "-x"))
    assert encoded(encoder, [text.encode()]) == [encoder.tokenizer.encode(text, add_special_tokens=False).ids]
    assert len(encoder.parts) < 40


def check_packed(rows, texts: dict) -> None:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_over_all_documents(spark, sf):
    check_packed(queries()["op7_best_fit_packing"](spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_packing_edge_cases(spark):
    texts = {1: None, 2: "", 3: " \t 　 ", 4: "one", 5: "many words " * 9000, 6: "x" * 30_000, 7: "a b c\x0bd\x85e", 8: "It's\n\n<|endoftext|> 12345 ÉTÉ", 9: "w " * 4095, 10: "w " * 4096}
    frame = table(spark, [(i, t, None, None) for i, t in texts.items()]).withColumn("length", F.lit(1)).withColumn("piece", F.lit("p"))
    check_packed(packing.pack_documents(frame, packing.default_tokenizer()).collect(), texts)
    twice = packing.pack_documents(frame.unionByName(frame), packing.default_tokenizer()).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pack_documents(frame.limit(0), packing.default_tokenizer()).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(unhex('6162FF2063') as string) as text union all select 2L, 'ab� c'")
    assert len({(r.length, r.ids_crc32) for r in packing.pack_documents(broken, packing.default_tokenizer()).collect()}) == 1


def test_packed_groups_without_full_sequences():
    """1500 + 1250 + 1250 and 2 x 1500 need 0.75 sequences for each piece of a length; best fit alone makes 0.83."""
    groups = packing.packed({1500: 10_000, 1250: 10_000})
    held = {x: sum(n * items.get(x, 0) for n, items in groups) for x in (1500, 1250)}
    assert held == {1500: 10_000, 1250: 10_000} and all(sum(x * a for x, a in items.items()) <= 4096 for _, items in groups)
    assert sum(n for n, _ in groups) <= 7550
    assert packing.best_configuration(np.array([300]), np.array([300.0]), 4096) == {300: 13}


@pytest.mark.parametrize("kinds,most", [(20, 1.01), (60, 1.02)])
def test_packing_comes_near_its_bound_where_best_fit_does_not(kinds, most):
    """Triplets that fill a sequence: as many sequences as triplets are enough, and the bound says so."""
    rng, histogram = np.random.default_rng(kinds), Counter()
    for _ in range(kinds):
        a, b = (int(x) for x in rng.integers(1030, 1700, 2))
        histogram.update({x: 100 for x in (a, b, 4096 - a - b)} if len({a, b, 4096 - a - b}) == 3 else {})
    need = sum(k * n for k, n in histogram.items()) // 4096
    groups, bound = packing.solved(dict(histogram))
    assert bound == need <= sum(n for n, _ in groups) <= most * need
    alone, _ = packing.solved(dict(histogram), rounds=0)
    assert sum(n for n, _ in alone) > 1.05 * need
    found, down, bound = packing.fractional({1500: 100, 1250: 100}, 4096)
    cover = Counter()
    for config, x in found:
        cover.update({k: a * x for k, a in config.items()})
    assert min(cover.values()) >= 100 - 1e-6 and max(cover.values()) * down <= 100 + 1e-6 and 0.98 * sum(x for _, x in found) <= bound <= 75.01


@pytest.mark.parametrize("capacity", [10, 37])
def test_packed_groups_hold_every_piece_once(capacity):
    rng = np.random.default_rng(4)
    histogram = {int(k): int(rng.integers(1, 40)) for k in rng.choice(np.arange(1, capacity + 1), capacity // 2, replace=False)}
    groups = packing.packed(histogram, capacity, rounds=200)
    held: Counter = Counter()
    for count, items in groups:
        assert sum(k * a for k, a in items.items()) <= capacity
        for k, a in items.items():
            held[k] += count * a
    assert held == histogram


# ---- the pipeline


def test_pipeline_stages_over_small_tables(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert list(rows) == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
    kept = rows["language"](spark, docs, sf)
    assert kept.columns == docs.columns
    texts = [r.text for r in rows["exact_dedup"](spark, kept, sf).collect()]
    assert sorted(texts) == sorted({r.text for r in kept.collect()})
    packed = corpus_pipeline.run(spark, sf)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() > 0
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
