"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces; what goes to the driver is only the histogram of piece
lengths, whose size is bounded by the sequence length. There multiplicative weights on the lengths
price configurations (sequences), a knapsack dynamic program finds the best one of each block of lengths,
and each gets a share of the lengths it uses, scaled to a feasible solution; the same prices give a
lower bound of what any packing needs. The solution is rounded down, full sequences first, and what that
leaves is solved again; the rest goes by best fit, decreasing, in groups of like sequences, beginning with
what rounding down leaves open where that saves sequences. The result is a table of bounded size: which
ranks of a length go to which configuration. Pieces get their rank within their length on the
executors and look their place up.
"""

from __future__ import annotations

import math
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import raw, slices, values
from .common import documents, join_small, staged

CAPACITY = 4096
END = 1
#: Configurations priced in the linear program, lengths that each may use, the share of a length's demand that one may cover, and how fast coverage lowers prices.
ROUNDS, PRICED, SHARE, GAIN = 400, 96, 0.25, 1.0
#: Times that what rounding down leaves is solved again, with a quarter of the rounds.
AGAIN = 4
#: Pieces of one length ranked together.
RANKED = 256
#: Parts of texts kept in a worker's table, and how many times as many may find no room before it is emptied.
PARTS, REFUSED = 550_000, 4
#: Bytes of text whose different parts are looked up together.
TEXT = 3 << 20
#: Words of letters encoded in one call, and the signs that may follow a word without being part of a token of it.
TOGETHER = 200
SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: The special tokens, which the tokenizer finds before anything else. No text is cut within them, and none is made by lower-casing.
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Kinds of bytes. All others (apart from ASCII, controls) stay with what is beside them.
OTHER, SPACE, LETTER, DIGIT, SIGN, APOSTROPHE = range(6)


def _kinds() -> bytes:
    kind = np.full(256, OTHER, np.uint8)
    for k, chars in ((SPACE, b" \n"), (LETTER, bytes(range(65, 91)) + bytes(range(97, 123))), (DIGIT, b"0123456789"), (SIGN, SIGNS), (APOSTROPHE, b"'")):
        kind[list(chars)] = k
    return kind.tobytes()


def _cuts() -> bytes:
    """Whether a part ends between two kinds, as 8 * first + second."""
    cut = np.zeros((32, 8), bool)
    cut[SPACE] = cut[:, SPACE] = True
    cut[LETTER, [DIGIT, SIGN, APOSTROPHE]] = True
    cut[DIGIT, [LETTER, DIGIT, SIGN, APOSTROPHE]] = True
    cut[SIGN, [LETTER, DIGIT]] = cut[APOSTROPHE, DIGIT] = True
    return cut.tobytes()


def _letters() -> np.ndarray:
    """Which two bytes, as one number, are a letter that stays one in lower case: of Latin (to U+017F, no signs and not U+0130) and Cyrillic (to U+047F)."""
    letter = np.zeros(1 << 16, bool)
    for c in (*range(0xC0, 0x180), *range(0x400, 0x480)):
        letter[int.from_bytes(chr(c).encode())] = c not in (0xD7, 0xF7, 0x130)
    return letter


KIND, CUT, LETTERS = _kinds(), _cuts(), _letters()


def parted(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of some texts one after the other, ASCII letters in lower case, and the number of parts before each offset.

    A capital stays one before a byte that is not ASCII: with a mark there may be one letter for the small one only.
    Texts are cut where every tokenization is: at spaces and line feeds, which go, behind runs of letters, around
    digits and behind signs. An apostrophe stays with the letters that follow, as the two may be a token.
    """
    whole = data.tobytes()
    found = whole.lower()
    kind, low = (np.frombuffer(bytearray(x), np.uint8) for x in (whole.translate(KIND), found))
    begin = at[:-1][at[:-1] < len(data)]
    beyond = np.flatnonzero(data[1:] > 127)  # in front of bytes that are not ASCII
    low[beyond] = data[beyond]
    kind[1:][beyond[LETTERS[data[beyond].astype(np.uint16) << 8 | data[1:][beyond]]]] = LETTER
    kind[begin] = np.frombuffer(KIND, np.uint8)[data[begin]]  # broken bytes at the end of one text and the beginning of the next are no letter
    kept = kind != SPACE
    first = np.ones(len(data), bool)
    first[1:] = np.frombuffer((kind[:-1] * np.uint8(8) + kind[1:]).tobytes().translate(CUT), bool)
    for token in SPECIAL:
        k = found.find(token)
        while k >= 0:
            end = k + len(token)
            low[k:end] = data[k:end]
            first[k + 1 : end] = False
            k = found.find(token, end)
    first[begin] = True
    first &= kept
    held = low[kept]
    offsets = np.append(np.flatnonzero(first[kept]), len(held))
    parts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    return parts, np.searchsorted(np.flatnonzero(first), at)


class Encoder:
    """The ids of text parts without white space, as bytes.

    A part of letters with signs behind it has the ids of its letters and of its signs, for no token spans the two. Words of letters
    are encoded many at once: each is to end with one token that ends a word. Where the count of those
    differs from that of the words, and for all other parts, each is encoded for itself.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[bytes, bytes] = {}
        self.refused = 0

    def singly(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def letters(self, words: list[bytes]) -> None:
        """Put the ids of these words into the table."""
        for start in range(0, len(words), 64 * TOGETHER):
            groups = [words[k : k + TOGETHER] for k in range(start, min(start + 64 * TOGETHER, len(words)), TOGETHER)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode("utf-8", "replace") for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) == len(group) and cuts[-1] == 4 * len(ids):
                    flat = ids.tobytes()
                    self.parts.update(zip(group, (flat[i:j] for i, j in zip([0, *cuts], cuts)), strict=True))
                else:
                    self.parts.update(zip(group, self.singly(group), strict=True))

    def learn(self, parts: Collection[bytes]) -> None:
        """Put the ids of these different parts into the table."""
        new = [p for p in parts if p not in self.parts]
        words, whole, split = [], [], []
        for p in new:
            if p.isalpha():
                words.append(p)
                continue
            word = p.rstrip(SIGNS)
            if word.isalpha() or unicodedata.normalize("NFC", word.decode("utf-8", "replace")).lower().isalpha():
                split.append((p, word, p[len(word) :]))
            else:
                whole.append(p)
        self.letters(list({*words, *(w for _, w, _ in split if w not in self.parts)}))
        for start in range(0, len(whole), 4096):
            some = whole[start : start + 4096]
            self.parts.update(zip(some, self.singly(some), strict=True))
        tails = list({t for _, _, t in split})
        ids = dict(zip(tails, self.singly(tails), strict=True))
        self.parts.update((p, self.parts[w] + ids[t]) for p, w, t in split)

    def forget(self) -> None:
        """Drop what the table has no room for, the latest first: what is frequent came early. Texts of another kind get their turn when it is emptied."""
        for _ in range(len(self.parts) - PARTS):
            self.parts.popitem()
            self.refused += 1
        if self.refused > REFUSED * PARTS:
            self.parts.clear()
            self.refused = 0

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after the other, and the number of ids before each offset."""
        parts, parts_at = parted(data, at)
        coded = parts.dictionary_encode()
        joined, cuts = raw(coded.dictionary)
        joined, cuts = joined.tobytes(), cuts.tolist()
        different = [joined[i:j] for i, j in zip(cuts, cuts[1:])]
        each = list(map(self.parts.get, different))
        new = [i for i, ids in enumerate(each) if ids is None]
        self.learn([different[i] for i in new])
        for i in new:
            each[i] = self.parts[different[i]]
        self.forget()
        held = np.frombuffer(b"".join(each), "<u4")
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        code = coded.indices.to_numpy()
        many = n[code]
        before = np.append(0, np.cumsum(many))
        return held[np.repeat((np.cumsum(n) - n)[code] - before[:-1], many) + np.arange(before[-1])], before[parts_at]

    def blocks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, where a single text of more than TEXT bytes is encoded in blocks that end with white space."""
        if len(at) > 2 or len(data) <= TEXT:
            return self.encode(data, at)
        whole, ids, first = data.tobytes(), [], 0
        while first < len(data):
            last = whole.find(b" ", first + TEXT) + 1 or len(data)
            ids.append(self.encode(data[first:last], np.array([0, last - first]))[0])
            first = last
        return np.concatenate(ids), np.array([0, sum(map(len, ids))])


_encoders: dict[str, Encoder] = {}


def tokenised(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces: id_col, piece, start, length, ids_crc32, and their ids if asked for.

    The tokenizer drops white space and no token spans it, nor the other cuts of `parted`, so that a text's ids
    are those of its parts; each different part of a slice is encoded once.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_file not in _encoders:
            _encoders[tokenizer_file] = Encoder(tokenizer_file)
        encoder = _encoders[tokenizer_file]
        for rows, data, at in slices(batches, text_col, TEXT):
            ids, ids_at = encoder.blocks(data, at)
            ids = np.insert(ids, ids_at[1:], END)
            ids_at = ids_at + np.arange(len(ids_at))
            total = np.diff(ids_at)
            pieces = -(-total // capacity)
            index = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(index)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(total[index] - piece * capacity, capacity)
            begin = ids_at[index] + piece * capacity
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            out = [values(rows, id_col).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.view("<i4"), pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_configuration(lengths: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming over the capacities: the multiset of lengths of highest price that fits. A length may be used as often as it fits, in parts of 1, 2, 4 and so on."""
    value = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for length, p in zip(lengths.tolist(), price.tolist(), strict=True):
        free, part = capacity // length, 1
        while free:
            times = min(part, free)
            free, part, size = free - times, 2 * part, times * length
            got = value[:-size] + times * p
            better = got > value[size:]
            taken.append((length, times, better))
            value[size:] = np.where(better, got, value[size:])
    found: dict[int, int] = {}
    c = int(value.argmax())
    for length, times, better in reversed(taken):
        if c >= (size := times * length) and better[c - size]:
            found[length] = found.get(length, 0) + times
            c -= size
    return found


def fractional(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float, float]:
    """The linear program by multiplicative weights: configurations and how many sequences of each, what to multiply these with to use no length too often, and a lower bound of their sum.

    Each round deals the lengths into blocks of about PRICED and prices each block's best configuration; its share
    lowers the prices of the lengths that it covers. The shares are scaled so that they cover most lengths, and what
    is then uncovered gets sequences of one length: a feasible solution. The prices, scaled so that no
    configuration of all lengths is worth more than one, are feasible in the dual: with them demand bounds any solution.
    """
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[x] for x in lengths.tolist()], float)
    bound = float((lengths * demand).sum()) / capacity
    if not rounds or not len(lengths):
        return [], 1.0, bound
    place = {x: i for i, x in enumerate(lengths.tolist())}
    cover, share = np.zeros(len(lengths)), {}
    blocks, rng = -(-len(lengths) // PRICED), np.random.default_rng(1)
    turns = -(-rounds // blocks)
    for turn in range(turns):
        order = rng.permutation(len(lengths))
        for block in range(blocks):
            some = np.sort(order[block::blocks])
            price = lengths[some] * np.exp(-GAIN * cover[some])
            config = best_configuration(lengths[some], price, capacity)
            step = SHARE * min(demand[place[x]] / a for x, a in config.items())
            key = tuple(sorted(config.items()))
            share[key] = share.get(key, 0) + step
            for x, a in config.items():
                cover[place[x]] += a * step / demand[place[x]]
        if blocks == 1 and turn % 50 == 49 or turn == turns - 1:
            y = lengths * np.exp(-GAIN * (cover - cover.min()))
            most = sum(y[place[x]] * a for x, a in best_configuration(lengths, y, capacity).items())
            bound = max(bound, float((y * demand).sum() / most))
    whole = sum(share.values())
    each = demand / (capacity // lengths)
    scales = [1 / c for c in np.quantile(cover[cover > 0], np.linspace(0, 0.9, 10))]
    scale = min(scales, key=lambda z: z * whole + float((np.maximum(0, 1 - z * cover) * each).sum()))
    found = [(dict(key), x * scale) for key, x in share.items()]
    found += [({int(x): int(capacity // x)}, n) for x, n in zip(lengths, np.maximum(0, 1 - scale * cover) * each, strict=True) if n > 0]
    return found, min(1.0, 1 / (scale * cover.max())), bound


def rounded(histogram: dict[int, int], found: list[tuple[dict[int, int], float]]) -> list[tuple[int, dict[int, int]]]:
    """Configurations and whole numbers of sequences, those of most first: rounded down and as far as pieces are left."""
    share: dict[tuple, float] = {}
    for config, x in found:
        key = tuple(sorted(config.items()))
        share[key] = share.get(key, 0) + x
    left, out = dict(histogram), []
    for key, x in sorted(share.items(), key=lambda s: (-s[1], s[0])):
        n = min(int(x + 1e-9), *(left.get(length, 0) // a for length, a in key))
        if n > 0:
            out.append((n, dict(key)))
            for length, a in key:
                left[length] -= n * a
    return out


def solved(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """Groups of like sequences, (count, {length: times}), that hold every piece of the histogram once, and a lower bound of their number."""
    left = {x: n for x, n in histogram.items() if n}
    closed: list[tuple[int, dict[int, int]]] = []
    if full := left.pop(capacity, 0):
        closed.append((full, {capacity: 1}))
    found, down, bound = fractional(left, capacity, rounds)
    least = full + math.ceil(bound - 1e-6)
    # Full sequences are rounded down first, and what is left is solved again.
    rest, groups, config = left, list(closed), found
    for _ in range(AGAIN):
        some = rounded(rest, [(c, x * down) for c, x in config if sum(k * a for k, a in c.items()) == capacity])
        if not some:
            break
        groups += some
        rest = dict(rest)
        for n, c in some:
            for k, a in c.items():
                rest[k] -= n * a
        rest = {k: n for k, n in rest.items() if n}
        config, down, _ = fractional(rest, capacity, rounds // 4)
    # What is still left goes by best fit: alone, with the program's other sequences rounded down and left open, or all from the start.
    tries = [
        lambda: groups + best_fit(rest, [], capacity),
        lambda: groups + best_fit(rest, rounded(rest, config), capacity),
        lambda: closed + best_fit(left, rounded(left, found), capacity),
        lambda: closed + best_fit(left, [], capacity),
    ]
    best: list | None = None
    for made in (t() for t in tries):
        if best is None or sum(n for n, _ in made) < sum(n for n, _ in best):
            best = made
        if sum(n for n, _ in best) <= least:  # no packing needs fewer
            break
    return best, least


def packed(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    return solved(histogram, capacity, rounds)[0]


def best_fit(histogram: dict[int, int], begun: list[tuple[int, dict[int, int]]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups for every piece of the histogram: those begun, whose room stays open, and what they do not hold by best fit, decreasing."""
    left = dict(histogram)
    open_at: dict[int, list[list]] = {}  # room left -> groups
    rooms: list[int] = []
    closed: list[tuple[int, dict[int, int]]] = []

    def put(count: int, items: dict[int, int], room: int) -> None:
        if not count:
            return
        if not room:
            closed.append((count, items))
            return
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append([count, items])

    for count, items in begun:
        for length, a in items.items():
            left[length] -= count * a
        put(count, items, capacity - sum(k * a for k, a in items.items()))
    # A group of like sequences takes pieces of one length together.
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put(n // each, {length: each}, capacity - each * length)
                if n % each:
                    put(1, {length: n % each}, capacity - (n % each) * length)
                break
            room = rooms[at]
            count, items = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
            each = room // length
            whole = min(count, n // each)
            if whole:
                put(whole, items | {length: items.get(length, 0) + each}, room - each * length)
                n -= whole * each
            if whole < count:
                rest = n if n < each else 0
                if rest:
                    put(1, items | {length: items.get(length, 0) + rest}, room - rest * length)
                    n = 0
                put(count - whole - bool(rest), items, room)
                if rest or not whole:
                    break
    for room, groups in open_at.items():
        closed.extend((count, items) for count, items in groups)
    return closed


def places(groups: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, times, first sequence, first offset) for each group and length."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, items in groups:
        offset = 0
        for length, times in sorted(items.items(), reverse=True):
            first = rank.get(length, 0)
            rank[length] = first + count * times
            rows.append((length, first, first + count * times - 1, times, sequence, offset))
            offset += length * times
        sequence += count
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, by=("doc_id", "piece")) -> DataFrame:
    """pieces (staged, with `length` from 1 to `capacity`) -> with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = places(packed(histogram, capacity, rounds))
    sizes = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, buckets long")
    where = spark.createDataFrame(table, "length long, first_rank long, last_rank long, times long, first_sequence long, first_offset long")
    # The rank within a length: buckets of about RANKED pieces, counted, and their counts summed up.
    rows = join_small(pieces, sizes, "length").withColumn("bucket", F.pmod(F.xxhash64(*by), F.col("buckets"))).drop("buckets")
    run = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*by)) - 1).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth"))
    spot = where.withColumnRenamed("length", "of_length")
    ranked = join_small(ranked, spot, (F.col("length") == F.col("of_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    nth = F.col("rank") - F.col("first_rank")
    return ranked.select(*pieces.columns, (F.col("first_sequence") + F.floor(nth / F.col("times"))).alias("sequence_id"), (F.col("first_offset") + nth % F.col("times") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """All documents, packed: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone. Only documents of more than `capacity` ids are cut.
    Repeated rows are packed each for itself; other columns are ignored; no rows give no rows.
    """
    return pack(staged(tokenised(docs, tokenizer_file, id_col, text_col, capacity), "pack-pieces"), capacity, by=(id_col, "piece"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(documents(spark, sf_dir), default_tokenizer())
