"""Vectorised numpy work on flat byte buffers: words, XXH64, winnowing, packed integers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
#: Constants of XXH64 (public specification).
P1, P2, P3, P4, P5 = U(11400714785074694791), U(14029467366897019727), U(1609587929392839161), U(9650029242287828579), U(2870177450012600261)
PAD = b"\0" * 16
SLICE = 1 << 21


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the machine; workers live from task to task."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def binary_column(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string or binary column as bytes objects; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int = SLICE):
    """Ranges (from, to) over consecutive items of about ``most`` bytes together; an item is never cut."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def loads(buffer: bytes, kind: str = "<u8") -> np.ndarray:
    """Little-endian integers at every byte position (unaligned view; the buffer ends in PAD)."""
    return np.ndarray((len(buffer) - 7,), dtype=kind, buffer=buffer, strides=(1,))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buffer: bytes, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of a buffer that ends in PAD, all at once."""
    out = np.empty(len(start), U)
    for a in range(0, len(start), 1 << 17):
        out[a : a + (1 << 17)] = _xxh64(buffer, start[a : a + (1 << 17)], length[a : a + (1 << 17)], seed)
    return out


def _xxh64(buffer: bytes, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    wide, four = loads(buffer), loads(buffer, "<u4")
    one = np.frombuffer(buffer, np.uint8)
    seed = U(seed)
    with np.errstate(over="ignore"):
        at, left = start.astype(np.int64), length.astype(np.int64)
        h = np.full(len(at), seed + P5, U)
        long = np.nonzero(left >= 32)[0]
        if len(long):
            v = [np.full(len(long), x, U) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            p, stripes = at[long].copy(), left[long] >> 5
            live = np.arange(len(long))
            turn = 0
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], wide[p[live] + 8 * k])
                p[live] += 32
                turn += 1
                live = live[stripes[live] > turn]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                x = (x ^ _round(U(0), v[k])) * P1 + P4
            h[long] = x
            at[long] = p
        h += left.astype(U)
        left = np.where(left >= 32, left & 31, left)
        for _ in range(3):
            live = np.nonzero(left >= 8)[0]
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ _round(U(0), wide[at[live]]), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
        live = np.nonzero(left >= 4)[0]
        if len(live):
            h[live] = _rotl(h[live] ^ (four[at[live]].astype(U) * P1), 23) * P2 + P3
            at[live] += 4
            left[live] -= 4
        for _ in range(3):
            live = np.nonzero(left > 0)[0]
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ (one[at[live]].astype(U) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        return h ^ (h >> U(32))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several documents, joined by single spaces in one buffer.

    start, length: of each word in ``buffer``; first: index of each document's first word, and the total at the end.
    """

    def __init__(self, docs: list[bytes]):
        joined = [b" ".join(d.split()) for d in docs]
        sizes = np.fromiter(map(len, joined), np.int64, len(joined))
        self.buffer = b" ".join(joined) + PAD
        base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(joined) else np.zeros(0, np.int64)
        space = np.flatnonzero(np.frombuffer(self.buffer, np.uint8)[: -len(PAD)] == 32)
        begin = np.concatenate([base[:1], space + 1])
        end = np.concatenate([space, [len(self.buffer) - len(PAD)]])
        keep = end > begin
        self.start, self.length = begin[keep], (end - begin)[keep]
        self.first = np.concatenate([np.searchsorted(self.start, base), [len(self.start)]]).astype(np.int64)


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over each ``width`` consecutive values."""
    out, step = values, 1
    if len(values) < width:
        return values[:0]
    while step * 2 <= width:
        out = op(out[: len(out) - step], out[step:])
        step *= 2
    return op(out[: len(out) - (width - step)], out[width - step :]) if step < width else out


def winnow(order: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least value of some window of ``width`` values; all of equal least ones.

    The windows begin at first[d] .. first[d] + count[d] - 1 for each document d. Whether a position is
    chosen for a window depends on the window's values alone, so equal windows choose alike.
    """
    least = sliding(order, width)
    if not len(least):
        return np.zeros(0, np.int64)
    step = np.zeros(len(order) + 1, np.int32)
    live = count > 0
    np.add.at(step, first[live], 1)
    np.add.at(step, first[live] + count[live], -1)
    inside = np.cumsum(step)[: len(least)] > 0
    # a position p is chosen if order[p] equals the least of a valid window that covers it
    top = np.zeros(len(order) + width - 1, order.dtype)
    top[width - 1 : width - 1 + len(least)] = np.where(inside, least + order.dtype.type(1), 0)
    reach = sliding(top, width, np.maximum)
    return np.flatnonzero((reach == order + order.dtype.type(1)) & (reach > 0))


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers as zstd-compressed byte planes."""
    v = np.ascontiguousarray(values, dtype="<u8")
    n = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()
    return bytes([n]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_ints(blob: bytes) -> np.ndarray:
    n = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    out = np.zeros((len(planes) // n, 8), np.uint8)
    out[:, :n] = planes.reshape(n, -1).T
    return out.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers as packed differences."""
    return pack_ints(np.diff(values, prepend=values.dtype.type(0)) if len(values) else values)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(blob), dtype=U)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 of all i, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)
