"""FLAC media columns: 8-bit mono streams written and read by numpy, many frames in step.

All frames of a slice of rows are coded at once: a frame is a lane, and step t handles sample t of every
lane. The writer tries constant, fixed and fourth-order linear prediction with Rice coded
residuals, and falls back to plain samples; frames get seek points with their first sample and
their byte offset (each one, in streams of up to POINTS frames). The reader starts a lane at every seek point (or at the first frame, if a stream
has no seek table), follows the frames of a lane to the next point, checks the CRC of each header
and each frame and the MD5 of the stream, and gives PCM blocks with their sample offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices, values
from .common import documents, staged

BLOCK = 256
RATE = 8000
ORDER, PRECISION = 4, 10
#: Seek points of a stream at most: a metadata block's length has three bytes.
POINTS = (1 << 24) // 18 - 1
#: Coefficients of the fixed predictors, by order; fixed values of the format.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def crc_table(width: int, poly: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for c in range(256):
        c <<= width - 8
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)
#: Leading zeros of a 16-bit number.
CLZ = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def crc(buf: np.ndarray, first: np.ndarray, length: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """The CRC of each stretch of bytes, all stretches in step."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    c, mask = np.zeros(len(first), np.int64), (1 << width) - 1
    left = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")  # lanes longer than t
    for t, n in enumerate(left):
        c[:n] = table[(c[:n] >> (width - 8)) ^ buf[first[:n] + t]] ^ ((c[:n] << 8) & mask)
    out = np.empty_like(c)
    out[order] = c
    return out


def predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x ORDER) and shifts of linear predictors for frames x samples, by the autocorrelation method."""
    r = np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(1) for k in range(ORDER + 1)], 1).astype(float)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-3
    a, err = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, err = new, err * np.maximum(1e-9, 1 - k * k)
    big = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(big)).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.round(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def rice(res: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the better Rice parameter of two near the mean, and the bits that they take."""
    u = (res << 1) ^ (res >> 31)
    k = np.clip(np.floor(np.log2(u.mean(1) + 1)).astype(np.int32) - 1, 0, 13)
    v = u >> k[:, None]
    bits = [v.sum(1) + u.shape[1] * (k + 1), (v >> 1).sum(1) + u.shape[1] * (k + 2)]
    better = bits[1] < bits[0]
    return u, k + better, np.where(better, bits[1], bits[0])


def subframes(x: np.ndarray) -> dict:
    """The cheapest coding of each frame (frames x samples): kind, order, coefficients, shift, parameter, folded residuals, bits."""
    n, size = x.shape
    coef, shift = predictors(x)
    best = {"kind": np.full(n, 1), "order": np.zeros(n, np.int64), "k": np.zeros(n, np.int64), "bits": np.full(n, 8 + 8 * size), "u": np.zeros((n, size), np.int32), "coef": coef, "shift": shift}
    tries = [(8 + o, o, None) for o in range(3)] + [(32 + ORDER - 1, ORDER, coef)]
    for kind, order, c in tries:
        if size <= order:
            continue
        pred = np.zeros((n, size - order), np.int32)
        for j in range(order):
            pred += (c[:, j : j + 1].astype(np.int32) if c is not None else np.int32(FIXED[order][j])) * x[:, order - 1 - j : size - 1 - j]
        if c is not None:
            pred >>= shift[:, None].astype(np.int32)
        u, k, bits = rice(x[:, order:] - pred)
        bits = bits + 8 + 8 * order + 10 + (0 if c is None else 9 + ORDER * PRECISION)
        win = bits < best["bits"]
        for name, v in (("kind", kind), ("order", order), ("k", k[win]), ("bits", bits[win])):
            best[name][win] = v
        rows = np.flatnonzero(win)
        best["u"][rows, order:] = u[rows]
    same = (x == x[:, :1]).all(1)
    best["kind"][same], best["order"][same], best["bits"][same] = 0, 0, 16
    return best


def put(words: np.ndarray, at: np.ndarray, value: np.ndarray, width) -> None:
    """Write numbers of at most 32 bits, highest bit first, into an array of 32-bit words; `at`, ascending, has the bit where each begins."""
    if not len(at):
        return
    word = at >> 5
    part = value.astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] += np.add.reduceat(part >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(part & np.uint64(0xFFFFFFFF), first)


def frame_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8 form: bytes (frames x 6) and lengths; for numbers below 2**31."""
    length = 1 + (n >= 0x80) + (n >= 0x800) + (n >= 0x10000) + (n >= 0x200000) + (n >= 0x4000000)
    out = np.zeros((len(n), 6), np.uint8)
    for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0), (5, 0xF8), (6, 0xFC)):
        own = length == size
        for j in range(size):
            part = n[own] >> (6 * (size - 1 - j))
            out[own, j] = (lead | part) if j == 0 else (0x80 | (part & 0x3F))
    return out, length


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of 8-bit samples (bytes less 128), of 16 samples at least."""
    sizes = np.array([len(p) for p in payloads])
    frames = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    first = np.repeat(np.cumsum(sizes) - sizes, frames) + number * BLOCK
    coded = {int(size): subframes(data[first[length == size][:, None] + np.arange(size)]) for size in np.unique(length)}
    bits = np.zeros(len(owner), np.int64)
    for size, c in coded.items():
        bits[length == size] = c["bits"]
    num, num_len = frame_number(number)
    short = length != BLOCK
    head = 4 + num_len + short + 1
    total = head + (bits + 7) // 8 + 2
    start = np.cumsum(total) - total
    out_bits = np.zeros(int(total.sum()) // 4 + 3, np.uint64)
    for size, c in coded.items():
        lanes = length == size
        at = (start + head)[lanes] * 8
        x = data[first[lanes][:, None] + np.arange(size)]
        put(out_bits, at, c["kind"] << 1, 8)
        at = at + 8
        plain = c["kind"] == 1
        put(out_bits, (at[plain][:, None] + 8 * np.arange(size)).ravel(), (x[plain] & 255).ravel(), 8)
        flat = c["kind"] == 0
        put(out_bits, at[flat], x[flat, 0] & 255, 8)
        for order in range(ORDER + 1):
            own = (c["kind"] > 1) & (c["order"] == order)
            if not own.any():
                continue
            p = at[own]
            for j in range(order):
                put(out_bits, p, x[own, j] & 255, 8)
                p = p + 8
            linear = c["kind"][own] >= 32
            put(out_bits, p[linear], np.full(int(linear.sum()), PRECISION - 1), 4)
            put(out_bits, p[linear] + 4, c["shift"][own][linear], 5)
            for j in range(order if linear.any() else 0):
                put(out_bits, p[linear] + 9 + PRECISION * j, c["coef"][own][linear, j] & ((1 << PRECISION) - 1), PRECISION)
            p = p + np.where(linear, 9 + PRECISION * order, 0) + 6
            k = c["k"][own]
            put(out_bits, p, k, 4)
            u = c["u"][own][:, order:]
            width = (u >> k[:, None]) + 1 + k[:, None]
            ends = (p + 4)[:, None] + np.cumsum(width, 1)
            low = (u & ((1 << k) - 1)[:, None]) | (1 << k)[:, None]
            put(out_bits, (ends - 1 - k[:, None]).ravel(), low.ravel(), np.repeat(k + 1, u.shape[1]))
    buf = np.frombuffer(bytearray(out_bits.astype(">u4").tobytes()), np.uint8)
    for j, v in enumerate((0xFF, 0xF8, np.where(short, 0x60, 0x80), 0x02)):
        buf[start + j] = v
    for j in range(6):
        own = num_len > j
        buf[(start + 4 + j)[own]] = num[own, j]
    buf[(start + 4 + num_len)[short]] = length[short] - 1
    buf[start + head - 1] = crc(buf, start, head - 1, CRC8, 8)
    check = crc(buf, start, total - 2, CRC16, 16)
    buf[start + total - 2], buf[start + total - 1] = check >> 8, check & 255
    streams, edge, raw = [], np.concatenate([[0], np.cumsum(frames)]), buf.tobytes()
    signed = (data.astype(np.int8)).tobytes()
    at = 0
    for i, n in enumerate(sizes.tolist()):
        a, b = edge[i], edge[i + 1]
        part = total[a:b]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(part.min()).to_bytes(3, "big") + int(part.max()).to_bytes(3, "big") + ((RATE << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(signed[at : at + n]).digest()
        points = np.zeros(b - a, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["offset"], points["size"] = number[a:b] * BLOCK, start[a:b] - start[a], length[a:b]
        table = points[:: -(-len(points) // POINTS)].tobytes()
        streams.append(b"fLaC" + b"\0" + (34).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + raw[start[a] : start[b - 1] + total[b - 1]])
        at += n
    return streams


def layout(stream: bytes) -> tuple[dict, np.ndarray, int]:
    """STREAMINFO, the (sample, offset) of the seek table's points, and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, {}, np.zeros((0, 2), np.int64)
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            v = int.from_bytes(body[10:18], "big")
            info = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind & 127 == 3:
            t = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
            t = t[t["sample"] != 2**64 - 1]
            points = np.stack([t["sample"].astype(np.int64), t["offset"].astype(np.int64)], 1)
        at += 4 + size
        if kind & 128:
            break
    if info.get("channels") != 1 or info["bits"] != 8:
        raise ValueError("only 8-bit mono streams are read")
    return info, points, at


class Bits:
    """A bit reader for many lanes: a 64-bit window at every byte."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        self.window = np.zeros(len(buf) + 9, np.uint64)
        for j in range(8):
            self.window |= padded[j : j + len(self.window)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.peek(at) >> np.uint64(64 - width)).astype(np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        v = self.take(at, width)
        return v - ((v >> (width - 1)) << width)


def headers(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block size and header length of the frames at these bytes; checks sync, sample size and CRC-8."""
    if ((buf[at] != 0xFF) | (buf[at + 1] & 0xFE != 0xF8) | (buf[at + 3] & 0xFE != 0x02)).any():
        raise ValueError("no frame of an 8-bit mono stream here")
    code, rate, lead = buf[at + 2] >> 4, buf[at + 2] & 15, buf[at + 4]
    num = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (lead >= 0xFC) + (lead >= 0xFE)
    size = np.where(code == 1, 192, np.where(code < 6, 576 << (code.astype(np.int64) - 2).clip(0), 256 << (code.astype(np.int64) - 8).clip(0)))
    p = at + 4 + num
    size = np.where(code == 6, buf[p].astype(np.int64) + 1, np.where(code == 7, (buf[p].astype(np.int64) << 8 | buf[p + 1]) + 1, size))
    length = 4 + num + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0)) + 1
    if (crc(buf, at, length - 1, CRC8, 8) != buf[at + length - 1]).any():
        raise ValueError("a frame header's CRC-8 does not match")
    return size, length


def unary(bits: Bits, at: np.ndarray) -> np.ndarray:
    """Zeros before the next one bit, in each lane."""
    q = CLZ[bits.take(at, 16)]
    far = np.flatnonzero(q == 16)
    more = 16
    while len(far):
        z = CLZ[bits.take(at[far] + more, 16)]
        q[far] = more + z
        far, more = far[z == 16], more + 16
    return q


class Residuals:
    """The residuals of many lanes, in step: partitions of Rice codes of either width, or of plain numbers (escapes)."""

    def __init__(self, bits: Bits, at: np.ndarray, size: int, order: np.ndarray):
        method = bits.take(at, 2)
        if (method > 1).any():
            raise ValueError("a reserved way to code residuals")
        self.bits, self.at, self.width = bits, at + 6, 4 + method
        self.part = size >> bits.take(at + 2, 4)  # samples of a partition, those before the first residual included
        if (self.part < order).any() or (self.part == 0).any():
            raise ValueError("a partition is shorter than the predictor")
        self.k, self.raw = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64) - 1
        self.next = np.zeros(len(at), np.int64)
        self.start(0, np.ones(len(at), bool))

    def start(self, t: int, which: np.ndarray) -> None:
        """Read the parameters of the partitions that begin at sample t."""
        for width in (4, 5):
            own = np.flatnonzero(which & (self.width == width))
            if not len(own):
                continue
            k = self.bits.take(self.at[own], width)
            self.at[own] += width
            plain = k == (1 << width) - 1
            self.k[own], self.raw[own] = np.where(plain, 0, k), -1
            if plain.any():
                self.raw[own[plain]] = self.bits.take(self.at[own[plain]], 5)
                self.at[own[plain]] += 5
        self.next[which] = t + self.part[which]

    def take(self, t: int, go: np.ndarray | None) -> np.ndarray:
        """The residual of sample t; lanes not to `go` have none yet."""
        begin = self.next == t
        if begin.any():
            self.start(t, begin)
        k = self.k
        q = unary(self.bits, self.at)
        low = ((self.bits.peek(self.at + q + 1) >> np.uint64(1)) >> (63 - k).astype(np.uint64)).astype(np.int64)
        u = (q << k) | low
        res, used = (u >> 1) ^ -(u & 1), q + 1 + k
        for width in np.unique(self.raw[self.raw >= 0]).tolist():
            own = np.flatnonzero(self.raw == width)
            res[own] = self.bits.signed(self.at[own], width) if width else 0
            used[own] = width
        self.at = self.at + (used if go is None else np.where(go, used, 0))
        return res


def samples(bits: Bits, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decode one subframe of `size` samples in each lane: samples (size x lanes) and the bit after it."""
    head = bits.take(at, 8)
    if (head & 0x80).any():
        raise ValueError("a subframe begins with a zero bit")
    kind, at = (head >> 1) & 63, at + 8
    wasted = np.where(head & 1, 1 + unary(bits, at), 0)
    at = at + wasted
    depth = 8 - wasted
    if (depth < 1).any():
        raise ValueError("more wasted bits than a sample has")
    out, end = np.zeros((size, len(at)), np.int64), at.copy()
    for d in np.unique(depth).tolist():
        lanes = np.flatnonzero(depth == d)
        pcm, end[lanes] = subframe(bits, at[lanes], size, kind[lanes], d)
        out[:, lanes] = pcm << (8 - d)
    return out, end


def subframe(bits: Bits, at: np.ndarray, size: int, kind: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The samples of `depth` bits behind the subframes' headers, and the bit after them."""
    out = np.zeros((size, len(at)), np.int64)
    flat, plain = kind == 0, kind == 1
    if flat.any():
        out[:, flat] = bits.signed(at[flat], depth)
    if plain.any():
        out[:, plain] = bits.signed((at[plain] + depth * np.arange(size)[:, None]).ravel(), depth).reshape(size, -1)
    end = at + np.where(flat, depth, np.where(plain, depth * size, 0))
    own = np.flatnonzero(kind > 1)
    if not len(own):
        return out, end
    kind, at = kind[own], at[own]
    linear = kind >= 32
    if ((~linear) & ((kind < 8) | (kind > 12))).any():
        raise ValueError("a reserved subframe type")
    order = np.where(linear, kind - 31, kind - 8)
    most = int(order.max())
    s = np.zeros((size + most, len(own)), np.int64)  # rows before `most` stand before the first sample
    for j in range(most):
        has = order > j
        s[most + j, has] = bits.signed(at[has], depth)
        at = at + depth * has
    coef, shift = np.zeros((most, len(own)), np.int64), np.zeros(len(own), np.int64)
    for o in range(1, 5):
        if (fixed := ~linear & (order == o)).any():
            coef[:o, fixed] = np.array(FIXED[o])[:, None]
    if linear.any():
        width = bits.take(at, 4) + 1
        shift = np.where(linear, bits.take(at + 4, 5), 0)
        at = at + 9 * linear
        for w in np.unique(width[linear]):
            sel = linear & (width == w)
            for j in range(most):
                has = sel & (order > j)
                coef[j, has] = bits.signed(at[has], int(w))
                at = at + int(w) * has
    residuals = Residuals(bits, at, size, order)
    for t in range(size):
        go = order <= t if t < most else None
        res = residuals.take(t, go)
        pred = np.zeros(len(own), np.int64)
        for j in range(most):
            pred += coef[j] * s[most + t - 1 - j]
        pred >>= shift
        s[most + t] = res + pred if go is None else np.where(go, res + pred, s[most + t])
    out[:, own] = s[most:]
    end[own] = residuals.at
    return out, end


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of each stream, (first sample, bytes), in order. Raises ValueError if a checksum does not match."""
    infos, base, lane_stream, lane_at, lane_sample, lane_stop = [], 0, [], [], [], []
    for i, stream in enumerate(streams):
        info, points, body = layout(stream)
        infos.append(info)
        first, where = (points[:, 0], points[:, 1]) if len(points) and points[0, 0] == 0 else (np.zeros(1, np.int64), np.zeros(1, np.int64))
        lane_stream.append(np.full(len(first), i))
        lane_at.append(base + body + where)
        lane_sample.append(first)
        lane_stop.append(np.append(first[1:], info["samples"]))
        base += len(stream)
    buf = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    bits = Bits(buf)
    owner, at, sample, stop = map(np.concatenate, (lane_stream, lane_at, lane_sample, lane_stop)) if streams else [np.zeros(0, np.int64)] * 4
    found: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    while len(at):
        size, head = headers(buf, at)
        after = np.zeros(len(at), np.int64)
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            pcm, end = samples(bits, (at[own] + head[own]) * 8, int(n))
            after[own] = (end + 7) // 8
            block = (pcm + 128).astype(np.uint8).T.tobytes()
            for j, lane in enumerate(own.tolist()):
                found[owner[lane]].append((int(sample[lane]), block[j * n : (j + 1) * n]))
        if (crc(buf, at, after - at, CRC16, 16) != (buf[after].astype(np.int64) << 8 | buf[after + 1])).any():
            raise ValueError("a frame's CRC-16 does not match")
        at, sample = after + 2, sample + size
        on = sample < stop
        owner, at, sample, stop = owner[on], at[on], sample[on], stop[on]
    for i, info in enumerate(infos):
        found[i].sort()
        signed = (np.frombuffer(b"".join(b for _, b in found[i]), np.uint8) ^ 128).tobytes()
        if len(signed) != info["samples"] or hashlib.md5(signed).digest() != info["md5"]:
            raise ValueError("the stream's MD5 does not match")
    return found


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media (a FLAC stream of the text's bytes, padded with zeros to a positive multiple of 64).

    Null text counts as empty; rows that repeat give equal streams; other columns are ignored, whatever their
    names; no rows give no rows. Texts are coded in slices, a long one in a slice of its own, up to the 2 GB of a binary value.
    """

    def run(batches):
        for rows, data, at in slices(batches, text_col):
            whole = data.tobytes()
            media = encode([padded(whole[at[i] : at[i + 1]]) for i in range(rows.num_rows)])
            yield pa.RecordBatch.from_arrays([values(rows, id_col), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id_col, first_sample, n_samples, pcm. A null or empty stream gives none."""

    def run(batches):
        for rows, data, at in slices(batches, media_col):
            whole, some = data.tobytes(), np.flatnonzero(np.diff(at))
            index, first, pcm = [], [], []
            for i, blocks in zip(some.tolist(), decode([whole[at[i] : at[i + 1]] for i in some]), strict=True):
                index += [i] * len(blocks)
                first += [s for s, _ in blocks]
                pcm += [b for _, b in blocks]
            yield pa.RecordBatch.from_arrays([values(rows, id_col).take(pa.array(index, pa.int64())), pa.array(first, pa.int64()), pa.array([len(b) for b in pcm], pa.int32()), pa.array(pcm, pa.binary())], names=[id_col, "first_sample", "n_samples", "pcm"])

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, first_sample long, n_samples int, pcm binary")


def feature(pcm: bytes) -> str:
    """Mean, root mean square and zero crossings of the samples, in integers and thousandths."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    return f"mean={int(x.sum()) * 1000 // len(x)};rms={int((int((x * x).sum()) * 1_000_000 // len(x)) ** 0.5)};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def read_back(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of what the stored streams give back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches):
        for rows, data, at in slices(batches, "media"):
            whole = data.tobytes()
            streams = [whole[at[i] : at[i + 1]] for i in range(rows.num_rows)]
            payloads = [b"".join(b for _, b in blocks) for blocks in decode(streams)]
            columns = [
                values(rows, id_col), values(rows, "n_bytes"), pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.array([feature(p) for p in payloads]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_flac_media(spark, sf_dir: str) -> DataFrame:
    """All documents, stored as FLAC streams in a table, and read back from it."""
    return read_back(staged(to_media(documents(spark, sf_dir)), "flac-media"))
