"""Byte formats of integer arrays, on numpy. Each pair of functions is lossless for every int32 array.

The formats are this library's own. Values are taken as unsigned 32-bit patterns; lengths are known from outside.
"""

from __future__ import annotations

import lzma
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard


def width_of(u: np.ndarray) -> int:
    return int(u.max()).bit_length() if len(u) else 0


def pack(u: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, most significant first, filled up to a whole byte."""
    bits = np.unpackbits(u.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits.ravel()).tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=width * n).reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - width :] = bits
    return np.packbits(full, axis=1).view(">u4").ravel().astype(np.uint32)


def _packed_size(width: int, n: int) -> int:
    return -(-width * n // 8)


class Bitpack:
    """One width for each group of values (0: for the whole array)."""

    def __init__(self, group: int = 0):
        self.group = group

    def encode(self, u: np.ndarray) -> bytes:
        step = self.group or max(len(u), 1)
        out = bytearray()
        for at in range(0, len(u), step):
            part = u[at : at + step]
            width = width_of(part)
            out.append(width)
            out += pack(part, width)
        return bytes(out)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        step, at, out = self.group or max(n, 1), 0, []
        for start in range(0, n, step):
            size, width = min(step, n - start), data[at]
            end = at + 1 + _packed_size(width, size)
            out.append(unpack(data[at + 1 : end], width, size))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint32)


class Varint:
    """Seven bits a byte, lowest first; the top bit says that more follow."""

    def encode(self, u: np.ndarray) -> bytes:
        wide = u.astype(np.uint64)
        groups = np.stack([(wide >> np.uint64(7 * i)) & np.uint64(127) for i in range(5)], axis=1).astype(np.uint8)
        count = np.maximum(1, 5 - np.argmax(groups[:, ::-1] != 0, axis=1)) * (groups.any(axis=1)) + (~groups.any(axis=1))
        inside = np.arange(5) < count[:, None]
        more = np.arange(5) < count[:, None] - 1
        return (groups | (more.astype(np.uint8) << 7))[inside].tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        last = np.flatnonzero(raw < 128)
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        shift = np.arange(len(raw)) - np.repeat(first, last - first + 1)
        parts = (raw & 127).astype(np.uint64) << (7 * shift).astype(np.uint64)
        return np.add.reduceat(parts, first).astype(np.uint32) if n else np.empty(0, np.uint32)


class StreamVbyte:
    """Two bits for each value's number of bytes, all of them first, then the bytes, lowest first."""

    def encode(self, u: np.ndarray) -> bytes:
        lengths = 1 + (u > 0xFF).astype(int) + (u > 0xFFFF) + (u > 0xFFFFFF)
        codes = np.concatenate([lengths - 1, np.zeros(-len(u) % 4, int)]).reshape(-1, 4)
        control = (codes << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
        return control.tobytes() + u.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]].tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        head = -(-n // 4)
        control = np.frombuffer(data[:head], np.uint8)
        lengths = ((control[:, None] >> np.array([0, 2, 4, 6])) & 3).ravel()[:n] + 1
        out = np.zeros((n, 4), np.uint8)
        out[np.arange(4) < lengths[:, None]] = np.frombuffer(data[head:], np.uint8)
        return out.view("<u4").ravel().astype(np.uint32)


class Frame:
    """The least value, a width (in bits, or rounded to bytes) and the packed distances from it."""

    def __init__(self, whole_bytes: bool = False):
        self.round = whole_bytes

    def encode(self, u: np.ndarray) -> bytes:
        v = u.view(np.int32).astype(np.int64)
        low = int(v.min()) if len(v) else 0
        d = (v - low).astype(np.uint32)
        width = -(-width_of(d) // 8) * 8 if self.round else width_of(d)
        return struct.pack("<iB", low, width) + pack(d, width)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        low, width = struct.unpack_from("<iB", data)
        return (unpack(data[5:], width, n).astype(np.int64) + low).astype(np.int32).view(np.uint32)


class PatchedFrame:
    """Groups packed at the width that costs least; what does not fit is patched: its place and its high bits."""

    def __init__(self, group: int = 128):
        self.group = group

    def encode(self, u: np.ndarray) -> bytes:
        out = bytearray()
        for at in range(0, len(u), self.group):
            part = u[at : at + self.group]
            need = np.frexp(part.astype(np.float64))[1]
            best = min(range(33), key=lambda w: _packed_size(w, len(part)) + 5 * int((need > w).sum()))
            odd = np.flatnonzero(need > best)
            low = part & np.uint32((1 << best) - 1) if best < 32 else part
            out += struct.pack("<BH", best, len(odd)) + pack(low, best) + odd.astype("<u2").tobytes() + (part[odd].astype(np.uint64) >> np.uint64(best)).astype("<u4").tobytes()
        return bytes(out)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        at, out = 0, []
        for start in range(0, n, self.group):
            size = min(self.group, n - start)
            width, odd = struct.unpack_from("<BH", data, at)
            at += 3
            part = unpack(data[at : at + _packed_size(width, size)], width, size)
            at += _packed_size(width, size)
            place = np.frombuffer(data, "<u2", odd, at)
            high = np.frombuffer(data, "<u4", odd, at + 2 * odd).astype(np.uint64)
            at += 6 * odd
            part[place] |= (high << np.uint64(width)).astype(np.uint32)
            out.append(part)
        return np.concatenate(out) if out else np.empty(0, np.uint32)


class WordAligned:
    """64-bit words: four bits tell how many values share the other sixty."""

    #: Values in a word and bits of each.
    LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]

    def encode(self, u: np.ndarray) -> bytes:
        need = np.maximum(np.frexp(u.astype(np.float64))[1], 1)
        values, out, at = u.tolist(), [], 0
        while at < len(values):
            for code, (count, width) in enumerate(self.LAYOUTS):
                part = need[at : at + count]
                if len(part) == count and part.max() <= width:
                    break
            word = code
            for i, v in enumerate(values[at : at + count]):
                word |= v << (4 + width * i)
            out.append(word)
            at += count
        return np.array(out, "<u8").tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        out: list[int] = []
        for word in np.frombuffer(data, "<u8").tolist():
            count, width = self.LAYOUTS[word & 15]
            word >>= 4
            for _ in range(count):
                out.append(word & ((1 << width) - 1))
                word >>= width
        return np.array(out[:n], np.uint32)


class ByteRuns:
    """Runs of equal bytes as (length - 1, byte); raw behind a flag where that is not smaller."""

    def encode(self, u: np.ndarray) -> bytes:
        raw = u.astype("<u4").view(np.uint8)
        if not len(raw):
            return b"\0"
        heads = np.concatenate([[0], np.flatnonzero(np.diff(raw)) + 1])
        lengths = np.diff(np.concatenate([heads, [len(raw)]]))
        pieces = -(-lengths // 256)
        size = np.full(int(pieces.sum()), 256)
        size[np.cumsum(pieces) - 1] = lengths - 256 * (pieces - 1)
        runs = np.stack([(size - 1).astype(np.uint8), np.repeat(raw[heads], pieces)], axis=1).tobytes()
        return b"\1" + runs if len(runs) < len(raw) else b"\0" + raw.tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        if data[:1] == b"\0":
            return np.frombuffer(data, "<u4", n, 1).astype(np.uint32)
        runs = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 2)
        return np.repeat(runs[:, 1], runs[:, 0].astype(int) + 1).view("<u4").astype(np.uint32)


class Bytes:
    """A general-purpose compressor over the little-endian bytes."""

    def __init__(self, squeeze, spread):
        self.squeeze, self.spread = squeeze, spread

    def encode(self, u: np.ndarray) -> bytes:
        return self.squeeze(u.astype("<u4").tobytes())

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.spread(data, 4 * n), "<u4").astype(np.uint32)


class Raw(Bytes):
    def __init__(self):
        super().__init__(bytes, lambda data, n: data)


def deflate() -> Bytes:
    return Bytes(lambda b: zlib.compress(b, 9), lambda b, n: zlib.decompress(b))


def lz4() -> Bytes:
    return Bytes(lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True), lambda b, n: pa.Codec("lz4_raw").decompress(b, n, asbytes=True) if n else b"")


def zstd(level: int) -> Bytes:
    return Bytes(lambda b: zstandard.ZstdCompressor(level=level).compress(b), lambda b, n: zstandard.ZstdDecompressor().decompress(b))


def xz() -> Bytes:
    return Bytes(lzma.compress, lambda b, n: lzma.decompress(b))


# ---- reversible maps of arrays before a byte format, modulo 2^32


def _delta(u):
    return np.diff(u, prepend=np.uint32(0))


def _undelta(u):
    return np.cumsum(u, dtype=np.uint32)


def _zz(u):
    d = u.view(np.int32)
    return ((d << 1) ^ (d >> 31)).view(np.uint32)


def _unzz(u):
    return (u >> np.uint32(1)) ^ (np.uint32(0) - (u & np.uint32(1)))


def _delta1(u):
    return _delta(u) - (np.arange(len(u)) > 0).astype(np.uint32)


def _undelta1(u):
    return _undelta(u + (np.arange(len(u)) > 0).astype(np.uint32))


def _xor(u):
    return u ^ np.concatenate([np.zeros(min(1, len(u)), np.uint32), u[:-1]])


def _unxor(u):
    return np.bitwise_xor.accumulate(u) if len(u) else u


#: Name, map and its inverse.
PREFILTERS = {
    "none": (lambda u: u, lambda u: u),
    "delta": (_delta, _undelta),
    "delta1": (_delta1, _undelta1),
    "zigzag": (lambda u: _zz(_delta(u)), lambda u: _undelta(_unzz(u))),
    "xor": (_xor, _unxor),
}


class Prefiltered:
    def __init__(self, prefilter: str, backend):
        self.forward, self.back = PREFILTERS[prefilter]
        self.backend = backend

    def encode(self, u: np.ndarray) -> bytes:
        return self.backend.encode(self.forward(u))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return self.back(self.backend.decode(data, n))
