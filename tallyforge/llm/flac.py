"""Lossless media columns: FLAC streams encoded and decoded with numpy, many frames at once.

The encoder takes 8-bit mono samples in blocks of 576 and picks for each frame a constant, verbatim, fixed or
least-squares linear-predictor subframe, whichever is shortest, with Rice-coded residuals. Every POINT_FRAMES-th frame has
a seek point, so that any sample is found without decoding what lies before its point, and the decoder works on all frames
of a batch in step. Frames between points are found by their numbered headers; where those mislead (samples may look like
one), which the sums show, by every header's and frame's sum.
The decoder takes any mono subframe kind (constant, verbatim, fixed 0-4, linear predictor up to order 32, Rice
partitions of both widths, escaped partitions, wasted bits) up to 24 bits; it checks each header's CRC-8, each frame's
CRC-16 and the MD5 of all samples.

Defined results: a null or empty text's payload is one block of bytes 255; null media decodes to no blocks; equal texts
give equal streams; repeated rows stay repeated; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_rows, pieces, written

BLOCK, RATE = 576, 8000
PIECE = 4 << 20
#: A seek point for each so many frames: 9216 samples, 1.2 seconds at the rate.
POINT_FRAMES = 16
#: Frames that are encoded in one step, so that its arrays stay in the processor's cache.
AT_ONCE = 256
LPC_ORDER, LPC_BITS = 4, 12
#: A frame is predicted only where that saves this share of it; else its samples are kept as they are (a verbatim subframe).
MIN_GAIN = 1 / 32


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & mask if c & top else c << 1 & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_rows(rows: list[bytes]) -> np.ndarray:
    """CRC-16 of each row: rows are aligned at their ends, as leading zeros leave the sum at zero."""
    if not rows:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(r) for r in rows])
    wide = int(sizes.max())
    grid = np.frombuffer(b"".join(r.rjust(wide, b"\0") for r in rows), np.uint8).reshape(len(rows), wide)
    columns = np.ascontiguousarray(grid.T)
    c = np.zeros(len(rows), np.uint16)
    table = CRC16.astype(np.uint16)
    for column in columns:
        c = (c << np.uint16(8)) ^ table[(c >> np.uint16(8)).astype(np.uint8) ^ column]
    return c.astype(np.uint32)


def coded_number(n: int) -> bytes:
    """The frame number in the UTF-8-like code of a frame header."""
    if n < 0x80:
        return bytes((n,))
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * k & 0x3F for k in range(size - 1)]
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *reversed(tail)])


@functools.lru_cache(1 << 16)
def frame_header(number: int, kind: bytes = b"\xff\xf8\x24\x02") -> bytes:
    head = kind + coded_number(number)  # 576 samples, 8 kHz, one channel, 8 bits, unless the kind says otherwise
    return head + bytes((crc8(head),))


# ---- encoding


def _pack(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Big-endian bit strings: the codes of each row in turn (each of 32 bits at most), filled up with zeros to a byte."""
    if values.shape[1] & 1:
        values, lengths = np.pad(values, ((0, 0), (0, 1))), np.pad(lengths, ((0, 0), (0, 1)))
    values = values[:, 0::2] << lengths[:, 1::2].astype(np.uint64) | values[:, 1::2]  # two codes make one of 64 bits at most
    lengths = lengths[:, 0::2] + lengths[:, 1::2]
    ends = np.cumsum(lengths, axis=1)
    bits = ends[:, -1]
    words = (bits + 63) // 64 + 1
    word_at = np.cumsum(words) - words
    at = (ends - lengths + word_at[:, None] * 64).ravel()
    values, lengths = values.ravel(), lengths.ravel()
    word = at >> 6
    room = 64 - (at & 63) - lengths
    left = values << np.maximum(room, 0).astype(np.uint64)
    over = np.flatnonzero(room < 0)
    left[over] = values[over] >> (-room[over]).astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    change = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[change]] = np.bitwise_or.reduceat(left, change)
    out[word[over] + 1] |= values[over] << (64 + room[over]).astype(np.uint64)
    raw = out.astype(">u8").tobytes()
    return [raw[8 * a : 8 * a + (b + 7) // 8] for a, b in zip(word_at.tolist(), bits.tolist())]


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter (within one of the mean's logarithm) and the bits of the residuals, for each row."""
    n = u.shape[1]
    k0 = np.clip(np.floor(np.log2(np.maximum(u.mean(1), 1e-9) + 1e-9)).astype(np.int64), 0, 13)
    best = np.full(len(u), 1 << 60, np.int64)
    k = k0.copy()
    for t in (k0, k0 + 1):
        q = u >> t[:, None].astype(u.dtype)
        bits = n * (1 + t) + q.sum(1, dtype=np.int64)
        better = (bits < best) & (q.max(1) + 1 + t <= 32)
        k, best = np.where(better, t, k), np.where(better, bits, best)
    return k, best


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def encode_frames(x: np.ndarray, numbers: np.ndarray, lpc: bool = True) -> list[bytes]:
    """A frame for each row of 576 signed 8-bit samples."""
    f, n = x.shape
    x = x.astype(np.int32)
    order = np.zeros(f, np.int64)
    d1, cost = np.diff(x, axis=1), np.abs(x[:, 4:]).sum(1)
    residual = {0: x, 1: d1, 2: np.diff(d1, axis=1)}
    for o in (1, 2):
        c = np.abs(residual[o][:, 4 - o :]).sum(1)
        order, cost = np.where(c < cost, o, order), np.minimum(c, cost)
    kind = order + 8  # fixed predictors
    coefs = np.zeros((f, LPC_ORDER), np.int64)
    shift = np.zeros(f, np.int64)
    if lpc:
        y = x.astype(np.float32)
        auto = [np.einsum("ij,ij->i", y[:, : n - lag], y[:, lag:], optimize=False).astype(np.float64) for lag in range(LPC_ORDER + 1)]
        auto[0] = auto[0] * 1.0001 + 1
        matrix = np.stack([np.stack([auto[abs(i - j)] for j in range(LPC_ORDER)], 1) for i in range(LPC_ORDER)], 1)
        real = np.linalg.solve(matrix, np.stack(auto[1:], 1)[..., None])[..., 0]
        high = np.maximum(np.abs(real).max(1), 1e-6)
        shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(high) + 1e-9).astype(np.int64), 0, 15)
        coefs = np.clip(np.rint(real * (1 << shift)[:, None]).astype(np.int64), -(1 << (LPC_BITS - 1)), (1 << (LPC_BITS - 1)) - 1)
        guess = np.zeros((f, n - LPC_ORDER), np.int32)
        for lag in range(LPC_ORDER):
            guess += coefs[:, lag, None].astype(np.int32) * x[:, LPC_ORDER - 1 - lag : n - 1 - lag]
        residual[32] = x[:, LPC_ORDER:] - (guess >> shift[:, None].astype(np.int32))
        c = np.abs(residual[32]).sum(1) + 24
        kind = np.where(c < cost, 32 + LPC_ORDER - 1, kind)
    kind = np.where((x == x[:, :1]).all(1), 0, kind)
    bodies: list[bytes] = [b""] * f
    raw = x.astype(np.int8).tobytes()
    for this in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == this)
        if this == 0:
            for i in rows.tolist():
                bodies[i] = b"\0" + raw[i * n : i * n + 1]
            continue
        o = this - 8 if this < 32 else LPC_ORDER
        u = _zigzag(residual[o if this < 32 else 32][rows]).astype(np.uint32)
        k, bits = _rice(u)
        short = bits + 8 * o + 10 + (9 + LPC_ORDER * LPC_BITS) * (this >= 32) < 8 * n * (1 - MIN_GAIN)
        for i in rows[~short].tolist():
            bodies[i] = b"\2" + raw[i * n : i * n + n]
        rows, u, k = rows[short], u[short], k[short]
        if not len(rows):
            continue
        codes = [(np.full(len(rows), this << 1), 8), *((x[rows, j] & 0xFF, 8) for j in range(o))]
        if this >= 32:
            codes += [(np.full(len(rows), LPC_BITS - 1), 4), (shift[rows], 5), *((coefs[rows, j] & ((1 << LPC_BITS) - 1), LPC_BITS) for j in range(LPC_ORDER))]
        codes += [(np.zeros(len(rows), np.int64), 6), (k, 4)]
        head = np.stack([c.astype(np.uint64) for c, _ in codes], 1)
        q = (u >> k[:, None].astype(np.uint32)).astype(np.int64)
        low = u.astype(np.uint64) & ((np.uint64(1) << k.astype(np.uint64)) - np.uint64(1))[:, None]
        values = np.concatenate([head, low | (np.uint64(1) << k.astype(np.uint64))[:, None]], 1)
        lengths = np.concatenate([np.tile(np.array([b for _, b in codes], np.int64), (len(rows), 1)), q + 1 + k[:, None]], 1)
        for i, body in zip(rows.tolist(), _pack(values, lengths)):
            bodies[i] = body
    heads: dict[int, bytes] = {}
    frames = [heads.get(m) or heads.setdefault(m, frame_header(m)) for m in numbers.tolist()]
    frames = [h + b for h, b in zip(frames, bodies)]
    return [d + struct.pack(">H", c) for d, c in zip(frames, crc16_rows(frames).tolist())]


def encode_payloads(payloads: list[bytes], lpc: bool = True) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 576; a byte b is the sample b - 128."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    grid = (np.frombuffer(b"".join(payloads), np.uint8) ^ np.uint8(0x80)).view(np.int8).reshape(-1, BLOCK)
    ends = np.cumsum(counts)
    numbers = np.arange(len(grid)) - np.repeat(ends - counts, counts)
    frames = [f for k in range(0, len(grid), AT_ONCE) for f in encode_frames(grid[k : k + AT_ONCE], numbers[k : k + AT_ONCE], lpc)]
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        own = frames[a:b]
        sizes = np.array([len(f) for f in own], np.int64)
        at = np.arange(0, b - a, POINT_FRAMES)
        points = np.zeros(len(at), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = at * BLOCK, (np.cumsum(sizes) - sizes)[at], BLOCK
        md5 = hashlib.md5(grid[a:b].tobytes()).digest()
        about = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | (b - a) * BLOCK).to_bytes(8, "big") + md5
        out.append(b"fLaC" + struct.pack(">I", 34) + about + struct.pack(">I", 0x83000000 | points.nbytes) + points.tobytes() + b"".join(own))
    return out


# ---- decoding


def _header(data: bytes, at: int) -> tuple[int, int]:
    """Block size of the frame at `at`, and where its subframe begins."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame here")
    if data[at + 3] >> 4:
        raise ValueError("one channel only")
    lead = data[at + 4]
    end = at + 5 + (0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1)
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    if code == 6:
        size, end = data[end] + 1, end + 1
    elif code == 7:
        size, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    else:
        size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:end]) != data[end]:
        raise ValueError("a frame header's CRC-8 differs")
    return size, end + 1


def _walk(stream: bytes, at: int, first: int, until: int, total: int) -> list[tuple[int, int, int]]:
    """(start, end, first sample) of the frames from that at `at`, which begins with sample `first`, up to sample `until`.

    Each next frame is where the header of the next number is; nothing is returned where frames are not all of one size."""
    size, body = _header(stream, at)
    kind, found = stream[at : at + 4], []
    if kind[1] & 1 or kind[2] >> 4 in (6, 7) or kind[2] & 15 >= 12 or first % size:
        return []
    for number in range(first // size + 1, -(-until // size) + 1):
        end = len(stream) if number * size >= total else stream.find(frame_header(number, kind), body)
        if end < 0:
            return []
        found.append((at, end, (number - 1) * size))
        at = end
    return found


def _blocks(stream: bytes) -> tuple[int, int, int, bytes, list[tuple[int, int, int]], int]:
    """Rate, bits, samples, MD5, seek points (sample, offset, samples) and where the first frame begins."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, points = 4, False, []
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            rate, bits, total, md5 = packed >> 44, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, block[18:34]
        elif kind == 3:
            points = [struct.unpack_from(">QQH", block, k) for k in range(0, size, 18)]
        at += 4 + size
    return rate, bits, total, md5, [p for p in points if p[0] != (1 << 64) - 1], at


def layout(stream: bytes, scan: bool = False) -> tuple[int, int, int, bytes, list[tuple[int, int, int]]]:
    """Rate, bits, samples, MD5 and (start, end, first sample) of each frame.

    Frames are found by their seek points where each has one, else by their numbers, else, or with `scan`, by all sums."""
    rate, bits, total, md5, points, at = _blocks(stream)
    if not scan and points and sum(p[2] for p in points) == total:
        starts = [at + p[1] for p in points]
        return rate, bits, total, md5, list(zip(starts, [*starts[1:], len(stream)], [p[0] for p in points]))
    if not scan and total and (found := _walk(stream, at, 0, total, total)):
        return rate, bits, total, md5, found
    starts, first, k = [], 0, at
    firsts = []
    while (k := stream.find(b"\xff", k)) >= 0 and k + 6 < len(stream):
        try:
            size = _header(stream, k)[0]
            if not starts or int(crc16_rows([stream[starts[-1] : k - 2]])[0]) == int.from_bytes(stream[k - 2 : k], "big"):
                starts.append(k)
                firsts.append(first)
                first += size
        except (ValueError, IndexError, KeyError):
            pass
        k += 1
    return rate, bits, total, md5, list(zip(starts, [*starts[1:], len(stream)], firsts))


def samples_at(stream: bytes, first: int, count: int) -> np.ndarray:
    """`count` samples from sample `first` on (fewer at the end), decoded from the last seek point before them on."""
    _, bits, total, _, points, audio = _blocks(stream)
    until = min(total, first + count)
    if first >= until:
        return np.zeros(0, np.int64)
    sample, offset, _ = max((p for p in points if p[0] <= first), default=(0, 0, 0))
    where = _walk(stream, audio + offset, sample, until, total)
    if not where or any(_sum_differs(stream[a:b]) for a, b, _ in where):
        return decode_streams([stream])[0][2][first:until].astype(np.int64)
    parts = [_subframes([stream[_header(stream, a)[1] : b - 2]], _header(stream, a)[0], bits)[0] for a, b, _ in where]
    return np.concatenate(parts).astype(np.int64)[first - where[0][2] : until - where[0][2]]


def _sum_differs(frame: bytes) -> bool:
    return int(crc16_rows([frame[:-2]])[0]) != int.from_bytes(frame[-2:], "big")


class _Bits:
    """A bit reader over many byte rows at once; every row has its own place."""

    def __init__(self, rows: list[bytes]):
        sizes = np.array([len(r) + 8 for r in rows], np.int64)
        flat = np.frombuffer(b"".join(r + b"\0" * 8 for r in rows) + b"\0" * 8, np.uint8).astype(np.uint64)
        n = len(flat) - 8
        self.window = flat[:n].copy()
        for k in range(1, 8):
            self.window <<= np.uint64(8)
            self.window |= flat[k : n + k]
        self.base = np.cumsum(sizes) - sizes
        self.limit = (self.base + sizes - 8) * 8
        self.at = self.base * 8

    def take(self, bits: int | np.ndarray, who=slice(None)) -> np.ndarray:
        """Up to 56 bits of each row; where `bits` is an array, each has its own width."""
        at = self.at[who].copy()
        self.at[who] = at + bits
        raw = self.window[at >> 3] << (at & 7).astype(np.uint64)
        if isinstance(bits, int):
            return raw >> np.uint64(64 - bits) if bits else np.zeros(len(at), np.uint64)
        return (raw >> np.uint64(1)) >> (63 - bits).astype(np.uint64)

    def signed(self, bits: int, who=slice(None)) -> np.ndarray:
        v = self.take(bits, who).astype(np.int64)
        return v - ((v >> (bits - 1)) << bits) if bits else v

    def rice(self, k: np.ndarray) -> np.ndarray:
        at = self.at
        raw = self.window[at >> 3] << (at & 7).astype(np.uint64)
        high = (raw >> np.uint64(32)).astype(np.float64)
        zeros = 1054 - (high.view(np.int64) >> 52)
        if (rare := np.flatnonzero((high == 0) | (zeros + 1 + k > 56))).size:
            zeros[rare] = [self._run(i) for i in rare.tolist()]
            self.at = at + zeros + 1
            low = self.take(k)
        else:
            low = ((raw << (zeros + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - k).astype(np.uint64)
            self.at = at + zeros + 1 + k
        u = (zeros << k) | low.astype(np.int64)
        return (u >> 1) ^ -(u & 1)

    def _run(self, i: int) -> int:
        at, n = int(self.at[i]), 0
        while not int(self.window[(at + n) >> 3]) >> 63 - ((at + n) & 7) & 1:
            n += 1
            if at + n >= self.limit[i]:
                raise ValueError("a residual runs past its frame")
        return n


# The coefficients of the fixed predictors.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _subframes(rows: list[bytes], size: int, bits: int) -> np.ndarray:
    """Samples of mono subframes that share the block size; rows begin at the subframe header."""
    out = np.zeros((len(rows), size), np.int32)
    kinds = np.array([r[0] for r in rows])
    for kind in np.unique(kinds).tolist():
        who = np.flatnonzero(kinds == kind)
        code = kind >> 1 & 0x3F
        if kind == 2 and bits == 8:  # verbatim bytes
            out[who] = np.frombuffer(b"".join(rows[i][1 : size + 1] for i in who.tolist()), np.int8).reshape(-1, size)
            continue
        read = _Bits([rows[i][1:] for i in who.tolist()])
        wasted = np.zeros(len(who), np.int64)
        if kind & 1:
            wasted = np.array([read._run(i) for i in range(len(who))]) + 1
            read.at += wasted
        for w in np.unique(wasted).tolist():
            mine = np.flatnonzero(wasted == w)
            part = _Bits.__new__(_Bits)
            part.window, part.base, part.limit, part.at = read.window, read.base[mine], read.limit[mine], read.at[mine]
            out[who[mine]] = _samples(part, code, size, bits - w) << w
    return out


def _samples(read: _Bits, code: int, size: int, bits: int) -> np.ndarray:
    n = len(read.at)
    x = np.zeros((size, n), np.int64)
    if code == 0:
        x[:] = read.signed(bits)
        return x.T
    if code == 1:
        for i in range(size):
            x[i] = read.signed(bits)
        return x.T
    order = code - 8 if 8 <= code <= 12 else code - 31 if code >= 32 else -1
    if order < 0:
        raise ValueError("a reserved subframe")
    for i in range(order):
        x[i] = read.signed(bits)
    if code >= 32:
        width, shift = read.take(4).astype(np.int64) + 1, read.signed(5)
        coefs = []
        for _ in range(order):
            v = read.take(width).astype(np.int64)
            coefs.append(v - ((v >> (width - 1)) << width))
        if (shift < 0).any():
            raise ValueError("a negative shift")
    else:
        coefs, shift = FIXED[order], 0
    method, parts = read.take(2).astype(np.int64), read.take(4).astype(np.int64)
    done = np.zeros((n, size), np.int64)
    for m, p in sorted(set(zip(method.tolist(), parts.tolist()))):
        if m > 1:
            raise ValueError("a reserved residual")
        mine = np.flatnonzero((method == m) & (parts == p))
        part = _Bits.__new__(_Bits)
        part.window, part.base, part.limit, part.at = read.window, read.base[mine], read.limit[mine], read.at[mine]
        y = np.ascontiguousarray(x[:, mine])
        cs = [c[mine] if isinstance(c, np.ndarray) else c for c in coefs]
        sh = shift[mine] if isinstance(shift, np.ndarray) else shift
        every, wide = size >> p, 4 + m
        escape = (1 << wide) - 1
        k = raw = None
        for i in range(order, size):
            if i == order or i % every == 0:
                k = part.take(wide).astype(np.int64)
                raw = np.flatnonzero(k == escape)
                if raw.size:
                    widths = part.take(5, raw).astype(np.int64)
            if raw.size:
                r = np.zeros(len(mine), np.int64)
                rest = np.flatnonzero(k != escape)
                for w in np.unique(widths).tolist():
                    r[raw[widths == w]] = part.signed(w, raw[widths == w])
                if rest.size:
                    sub = _Bits.__new__(_Bits)
                    sub.window, sub.base, sub.limit, sub.at = part.window, part.base[rest], part.limit[rest], part.at[rest]
                    r[rest] = sub.rice(k[rest])
                    part.at[rest] = sub.at
            else:
                r = part.rice(k)
            if cs:
                guess = cs[0] * y[i - 1]
                for lag in range(1, order):
                    guess = guess + cs[lag] * y[i - 1 - lag]
                r = r + (guess >> sh)
            y[i] = r
        done[mine] = y.T
    return done


def decode_streams(streams: list[bytes], scan: bool = False) -> list[tuple[int, int, np.ndarray, list[tuple[int, int]]]]:
    """(rate, bits, samples, [(first sample, samples) of each block]) of each stream, every sum checked."""
    plans = [layout(s, scan) for s in streams]
    starts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    frames: list[bytes] = []
    subs: list[bytes] = []
    known: dict[bytes, tuple[int, int]] = {}
    shape: list[list[tuple[int, int]]] = []
    for s, (_, bits, _, _, where) in zip(streams, plans):
        blocks = []
        for a, b, first in where:
            key = s[a : a + 16]
            size, body = known.get(key[:7], (0, 0))
            if not size:
                size, body = _header(s, a)
                body -= a
                if body <= 7:
                    known[key[:7]] = (size, body)
            starts.setdefault((size, bits), []).append((len(frames), len(shape)))
            frames.append(s[a : b - 2])
            subs.append(s[a + body : b - 2])
            blocks.append((first, size))
        shape.append(blocks)
    said = [int.from_bytes(s[b - 2 : b], "big") for s, p in zip(streams, plans) for _, b, _ in p[4]]
    wrong = np.flatnonzero(crc16_rows(frames) != np.array(said)) if frames else []
    if len(wrong):
        if scan:
            raise ValueError("a frame's CRC-16 differs")
        ends = np.cumsum([len(blocks) for blocks in shape])
        again = set(np.searchsorted(ends, wrong, "right").tolist())
        sure = iter(decode_streams([s for i, s in enumerate(streams) if i not in again]))
        return [decode_streams([s], True)[0] if i in again else next(sure) for i, s in enumerate(streams)]
    decoded: list[np.ndarray | None] = [None] * len(frames)
    for (size, bits), members in starts.items():
        grid = _subframes([subs[i] for i, _ in members], size, bits)
        for (i, _), row in zip(members, grid):
            decoded[i] = row
    out, at = [], 0
    for (rate, bits, total, md5, _), blocks in zip(plans, shape):
        own = decoded[at : at + len(blocks)]
        at += len(blocks)
        x = np.concatenate(own) if own else np.zeros(0, np.int32)
        raw = x.astype(np.int8).tobytes() if bits <= 8 else x.astype("<i2").tobytes() if bits <= 16 else x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        if len(x) != total or any(md5) and hashlib.md5(raw).digest() != md5:
            raise ValueError("the samples differ from the stream's MD5")
        out.append((rate, bits, x, blocks))
    return out


# ---- operators


def payload(text: bytes) -> bytes:
    text = bytes(text)
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\xff")


def encode_column(df: DataFrame, text: str, keep: list[str], lpc: bool = True) -> DataFrame:
    """The columns `keep`, n_bytes, payload_bytes and the stream `media` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, PIECE):
            rows = byte_rows(batch.column(batch.schema.get_field_index(text)))
            loads = [payload(r) for r in rows]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(r) for r in rows], pa.int64()), pa.array([len(p) for p in loads], pa.int64()), pa.array(encode_payloads(loads, lpc), pa.binary())], [*keep, "n_bytes", "payload_bytes", "media"])

    kinds = dict(df.dtypes)
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes bigint, payload_bytes bigint, media binary"]))


def pcm_blocks(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """A row for each block: its number, the offset of its first sample, its samples as little-endian PCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, media, PIECE):
            column = batch.column(batch.schema.get_field_index(media))
            which = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            rows = byte_rows(column)
            owner, number, offset, count, pcm = [], [], [], [], []
            for i, (_, bits, x, blocks) in zip(which.tolist(), decode_streams([bytes(rows[i]) for i in which.tolist()])):
                for k, (first, size) in enumerate(blocks):
                    kind = "<i1" if bits <= 8 else "<i2" if bits <= 16 else "<i4"
                    owner.append(i), number.append(k), offset.append(first), count.append(size), pcm.append(x[first : first + size].astype(kind).tobytes())
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(owner, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int32()), pa.array(offset, pa.int64()), pa.array(count, pa.int32()), pa.array(pcm, pa.binary())], [*keep, "block_no", "sample_offset", "n_samples", "pcm"])

    kinds = dict(df.dtypes)
    return df.select(*dict.fromkeys([*keep, media])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "block_no int, sample_offset bigint, n_samples int, pcm binary"]))


def feature(rate: int, x: np.ndarray, blocks: int) -> str:
    """Loudness, zero crossings and range of the samples."""
    wide = x.astype(np.int64)
    n = max(1, len(x))
    power = int((wide * wide).sum())
    crossings = int(((x[1:] < -32) != (x[:-1] < -32)).sum())
    return f"rate={rate};blocks={blocks};rms={(power / n) ** 0.5:.4f};crossings={crossings};low={int(x.min()) if len(x) else 0};high={int(x.max()) if len(x) else 0}"


def summaries(df: DataFrame) -> DataFrame:
    """The rows of encode_column(), each stream decoded and described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", PIECE):
            streams = [bytes(r) for r in byte_rows(batch.column(3))]
            sha, tail, media, said = [], [], [], []
            for s, (rate, _, x, blocks) in zip(streams, decode_streams(streams)):
                raw = (x.astype(np.int8).view(np.uint8) ^ np.uint8(0x80)).tobytes()
                sha.append(hashlib.sha256(raw).hexdigest())
                tail.append(zlib.crc32(raw[-32:]))
                media.append(hashlib.sha256(s).hexdigest())
                said.append(feature(rate, x, len(blocks)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha), pa.array(tail, pa.int64()), pa.array([len(s) for s in streams], pa.int64()), pa.array(media), pa.array(said)], OP8)

    return df.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


OP8 = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return summaries(written(encode_column(documents, "text", ["doc_id"]), "flac-media"))
