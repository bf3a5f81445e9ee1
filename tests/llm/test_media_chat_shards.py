"""FLAC streams, quotation linking and tiered shards."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import chat, flac, sharding
from harvestry.llm.common import fresh_path
from harvestry.llm.registry import oracle_sql, queries

# ---- FLAC


def payloads() -> list[bytes]:
    rng = random.Random(2)
    out = [b"", b"a", b"x" * 5000, bytes(range(256)) * 5, rng.randbytes(3001), "naïve été ".encode() * 700, b"\x00\xff" * 900]
    return [flac.padded(p) for p in [*out, b"".join(bytes([128 + int(90 * (i % 37) / 37)]) for i in range(9000))]]


def test_flac_round_trip_and_seek_points():
    made = flac.encode(payloads())
    for payload, stream, blocks in zip(payloads(), made, flac.decode(made), strict=True):
        assert b"".join(b for _, b in blocks) == payload
        assert [s for s, _ in blocks] == list(range(0, len(payload), flac.BLOCK))
        info, points, body = flac.layout(stream)
        assert info["samples"] == len(payload)
        for sample, offset in points.tolist():  # each point leads to a frame
            assert stream[body + offset : body + offset + 2] == b"\xff\xf8" and sample % flac.BLOCK == 0
    assert len(made[2]) < 1000  # one letter repeated: little more than the seek table


def test_flac_reads_streams_without_seek_table():
    stream = flac.encode([payloads()[5]])[0]
    info, points, body = flac.layout(stream)
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[body:]
    assert b"".join(b for _, b in flac.decode([bare])[0]) == payloads()[5]


def foreign(payload: bytes, wasted: int, width: int, parts: int, escape: int | None) -> bytes:
    """A stream of one frame as other writers make them: second-order fixed prediction, several partitions, wasted bits, escaped ones."""
    x = [b - 128 >> wasted for b in payload]
    bits = "0" + format(10, "06b") + ("1" + "0" * (wasted - 1) + "1" if wasted else "0")
    bits += "".join(format(v & (1 << 8 - wasted) - 1, f"0{8 - wasted}b") for v in x[:2]) + format(width - 4, "02b") + format(parts.bit_length() - 1, "04b")
    each = len(x) // parts
    for p in range(parts):
        res = [x[i] - 2 * x[i - 1] + x[i - 2] for i in range(max(2, p * each), (p + 1) * each)]
        if p == escape:
            bits += "1" * width + format(11, "05b") + "".join(format(r & 2047, "011b") for r in res)
            continue
        k = 1 + p
        bits += format(k, f"0{width}b")
        for r in res:
            u = 2 * r if r >= 0 else -2 * r - 1
            bits += "0" * (u >> k) + "1" + format(u & (1 << k) - 1, f"0{k}b")
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x70, 0x02, 0]) + (len(x) - 1).to_bytes(2, "big")

    def crc(data: bytes, table, n: int) -> int:
        c = 0
        for b in data:
            c = int(table[c >> n - 8 ^ b]) ^ (c << 8) & (1 << n) - 1
        return c

    frame = head + bytes([crc(head, flac.CRC8, 8)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += crc(frame, flac.CRC16, 16).to_bytes(2, "big")
    signed = bytes((v << wasted) & 255 for v in x)
    info = struct.pack(">HH", len(x), len(x)) + bytes(6) + ((8000 << 44) | (7 << 36) | len(x)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + frame


@pytest.mark.parametrize("wasted,width,parts,escape", [(0, 4, 1, None), (0, 4, 4, None), (0, 5, 2, None), (0, 4, 4, 2), (2, 4, 1, None), (3, 5, 4, 0)])
def test_flac_reads_what_other_writers_use(wasted, width, parts, escape):
    rng = random.Random(wasted + parts)
    payload = bytes((128 + int(60 * math.sin(i / 9)) + rng.randrange(5)) >> wasted << wasted for i in range(400))
    assert flac.decode([foreign(payload, wasted, width, parts, escape), flac.encode([payload])[0]])[0] == [(0, payload)]


def test_flac_frame_numbers_and_sparse_seek_points(monkeypatch):
    numbers = np.array([0, 127, 128, 2047, 2048, 65535, 65536, (1 << 21) - 1])
    out, length = flac.frame_number(numbers)
    assert [bytes(o[:n]).decode("utf-8", "surrogatepass") if n < 4 or v < 0x110000 else None for o, n, v in zip(out, length, numbers)][:7] == [chr(v) for v in numbers[:7].tolist()]
    assert flac.frame_number(np.array([1 << 21, (1 << 31) - 1]))[1].tolist() == [5, 6]
    monkeypatch.setattr(flac, "POINTS", 3)
    payload = payloads()[5]
    stream = flac.encode([payload])[0]
    assert len(flac.layout(stream)[1]) <= 3 and b"".join(b for _, b in flac.decode([stream])[0]) == payload


@pytest.mark.parametrize("at", [-1, -40, 60])
def test_flac_checksums_tell_damage(at):
    stream = bytearray(flac.encode([payloads()[5]])[0])
    body = flac.layout(bytes(stream))[2]
    stream[body + at if at > 0 else at] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_flac_media_over_all_documents(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got, made = queries()["op5_flac_media"](spark, sf).collect(), {}
    assert len(got) == len(texts)
    for r in got:
        p = flac.padded(texts[r.doc_id])
        assert len(p) % 64 == 0 and p
        stream = made.setdefault(p, flac.encode([p])[0])  # equal texts, equal streams
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), flac.feature(p))


def test_flac_columns_with_nulls_and_clashing_names(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "abc"), (3, "long " * 60_000)], "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    media = flac.to_media(frame)
    assert sorted((r.doc_id or 0, r.payload_bytes) for r in flac.read_back(media).collect()) == [(0, 64), (1, 64), (2, 64), (2, 64), (3, 300_032)]
    assert flac.pcm_blocks(media).where("doc_id = 3").agg(F.sum("n_samples"), F.max("first_sample")).first()[:] == (300_032, 300_031 // 256 * 256)
    assert flac.pcm_blocks(media.limit(0)).count() == 0 == flac.read_back(flac.to_media(frame.limit(0))).count()


# ---- quotations


def test_quote_linking_matches_sql(same_as_sql):
    assert same_as_sql(queries()["op1_quote_linking"], oracle_sql()["op1_quote_linking"])


def test_nested_quotes_are_linked_and_taken_out(spark):
    rows = [
        (1, 1, "a", "Hello there.\n\nSecond part."),
        (1, 2, "b", "a wrote:\n> hello   THERE.\n\nAn answer."),
        (1, 3, "c", "b wrote:\n> An answer.\n>> Hello there.\nThanks."),
        (1, 4, "d", "> never said\nNo link."),
        (1, 5, "e", "> Second part.\nOther branch."),
        (2, 1, "a", "> An answer.\nAnother conversation."),
        (2, 2, None, None),
        (None, 1, "x", "> q\nbody"),
        (3, None, "x", "body"),
        (4, 1, "a", ">" * 50 + " deep"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("hash", F.lit(1)).withColumn("body", F.lit("z"))
    got = {(r.conv_id, r.turn): r for r in chat.threaded(frame).collect()}
    assert len(got) == len(rows)
    assert [(got[1, t].reply_to, got[1, t].thread_root, got[1, t].depth, got[1, t].position) for t in (1, 2, 3, 4, 5)] == [(None, 1, 0, 0), (1, 1, 1, 1), (2, 1, 2, 2), (None, 4, 0, 0), (1, 1, 1, 3)]
    assert [(x.level, x.said_at) for x in got[1, 3].links] == [(1, 2), (2, 1)]
    assert (got[1, 3].body, got[1, 3].n_quotes, got[1, 3].n_linked) == ("Thanks.", 2, 2)
    assert (got[2, 1].reply_to, got[2, 2].body, got[None, 1].body, got[4, 1].body) == (None, "", "body", "")
    threads = {(r.conv_id, r.thread_root): [m.body for m in r.messages] for r in chat.assembled(chat.threaded(frame)).collect()}
    assert threads[1, 1] == ["Hello there.\n\nSecond part.", "An answer.", "Thanks.", "Other branch."]
    assert chat.threaded(frame.limit(0)).count() == 0


def test_replies_follow_the_message_they_answer(spark):
    """Random trees: reply order is the order of a walk that takes a message's replies by turn, each with all below it."""
    rng, rows, want = random.Random(6), [], {}
    for conv in range(6):
        parent = {i: rng.choice([None, *range(i)]) if i and rng.random() < 0.9 else None for i in range(30)}
        rows += [(conv, i, "r", f"said {i} in {conv}" + (f"\n> said {p} in {conv}" if p is not None else "")) for i, p in parent.items()]

        def walk(i, root, place, conv=conv, parent=parent):
            want[conv, i] = (root, place)
            for k in (k for k in parent if parent[k] == i):
                place = walk(k, root, place + 1)
            return place

        for i in parent:
            if parent[i] is None:
                walk(i, i, 0)
    got = {(r.conv_id, r.turn): (r.thread_root, r.position) for r in chat.threaded(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == want


def test_trimmed_quotes_are_linked_by_their_lines(spark):
    rows = [(1, 0, "a", "A first line of some length\nand a second line of some length"), (1, 1, "b", "something else that is long enough"), (1, 2, "c", "> and a second line of some length\n> [cut]\nMy answer")]
    got = {r.turn: r.reply_to for r in chat.threaded(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0}


def test_a_chain_of_replies_is_followed_to_its_root(spark):
    rows = [(1, i, "r", f"line {i}" + (f"\n> line {i - 1}" if i else "")) for i in range(40)]
    got = {r.turn: r for r in chat.threaded(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert all(got[i].thread_root == 0 and got[i].depth == i == got[i].position for i in range(40))


# ---- shards


def test_shards_give_back_every_row(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op10_tiered_shards"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.text_sha256) for r in got} == {i: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()}
    assert len(got) == len(docs)
    for shard in {r.shard for r in got}:
        own = [r for r in got if r.shard == shard]
        assert {r.shard_rows for r in own} == {len(own)}


def test_like_shards_merge_and_old_versions_stay_readable(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ARRIVAL_ROWS", 10)
    store = sharding.Store(spark, fresh_path(spark, "test-store"))
    assert store.version() == 0 and store.manifest().count() == 0
    frame = spark.createDataFrame([(i, None if i % 7 == 0 else "t" * i, "m") for i in range(200)], "doc_id long, text string, path string").coalesce(2)
    assert store.append(frame) == 1 and store.append(frame) == 2
    small = store.manifest(2).count()
    assert store.compact() and store.version() == 3
    while store.compact():
        pass
    assert store.manifest().count() < small == store.manifest(2).count()
    assert sorted(r.doc_id for r in store.read(store.manifest()).collect()) == sorted([*range(200)] * 2)
    assert store.read(store.manifest(1)).count() == 200
    with pytest.raises(Exception):  # another writer was first
        store.commit(store.manifest(1), 1)
    assert store.manifest().agg(F.sum("n_rows")).first()[0] == 400


def test_an_empty_table_is_a_store_without_rows(spark):
    store = sharding.Store(spark, fresh_path(spark, "test-store"))
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert not store.compact() and store.manifest().count() == 0
    assert store.read(store.manifest(), "tier").columns == ["doc_id", "text", "shard_path", "tier"] and store.read(store.manifest()).count() == 0


def test_the_query_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries()["op10_tiered_shards"](spark, str(tmp_path)).count() == 0


def brute_tiers(sizes: dict[str, int], target: int) -> set[frozenset[str]]:
    """The groups of paths that one round merges."""
    tiers: dict[int, list[str]] = {}
    for path in sorted(sizes):
        if 2 * sizes[path] <= target:
            tiers.setdefault(int(math.log(max(1, sizes[path]), 4) + 1e-9), []).append(path)
    groups = set()
    for paths in tiers.values():
        if len(paths) < sharding.LEAST_RUNS:
            continue
        cuts, before = {}, 0
        for p in paths:
            cuts.setdefault(before // target, []).append(p)
            before += sizes[p]
        groups |= {frozenset(own) for own in cuts.values() if len(own) > 1}
    return groups


def test_rounds_merge_the_groups_that_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ARRIVAL_ROWS", 7)
    store = sharding.Store(spark, fresh_path(spark, "test-store"), target=3000)
    rng = random.Random(8)
    rows = [(i if i % 9 else None, "x" * rng.choice([1, 30, 200]) if i % 5 else None, i) for i in range(300)]
    store.append(spark.createDataFrame(rows, "doc_id long, text string, group long").repartition(6))
    rounds = 0
    while True:
        before = {r.path: r for r in store.manifest().collect()}
        want = brute_tiers({p: r.n_bytes for p, r in before.items()}, 3000)
        got: dict = {}
        for r in store.plan(store.manifest()).collect():
            got.setdefault(r.shard_group, set()).add(r.path)
        assert {frozenset(g) for g in got.values()} == want
        assert store.compact() == bool(want)
        if not want:
            break
        rounds += 1
        after = {r.path: r for r in store.manifest().collect()}
        new = [after[p] for p in after.keys() - before.keys()]
        assert sorted(r.n_bytes for r in new) == sorted(sum(before[p].n_bytes for p in g) for g in want)
        held = {r.shard_path: r for r in store.read(store.manifest()).groupBy("shard_path").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"), F.min("doc_id").alias("lo")).collect()}
        assert all((held[r.path].n, held[r.path].b or 0, held[r.path].lo) == (r.n_rows, r.n_bytes, r.min_id) for r in after.values())
    assert rounds and sorted((r.doc_id or 0, r.text or "", r.group) for r in store.read(store.manifest()).collect()) == sorted((i or 0, t or "", g) for i, t, g in rows)
