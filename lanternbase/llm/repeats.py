"""Finding windows of units (bytes or words) that also start in a document with a smaller id, over a whole corpus.

Both substring operators stand on this frame; they differ in their units and in the solver of a block.

1. ``blocks``: distinct texts (by MD5) with their two smallest doc_ids are dealt over P partitions as packed blocks. Exact
   copies travel as one text: the solver judges the second copy against the first in ``_finish``, and the others share its result, so a hot text is one text.
2. ``_offer``: winnowing chooses gram positions ("anchors") such that every window holds one, chosen by the window's content
   alone; equal windows have equal anchors. Each partition offers each anchor hash once, with how often it has it.
3. ``_share``: by hash range, the anchors found in two or more texts are told to the partitions that have them.
   Anchors with more than ``HOT`` occurrences are marked.
4. ``_send``: the stretch of text whose windows hold a shared anchor (a "fragment") goes to the anchor's block; equal
   fragments of a partition go once, with all places. At marked anchors, each window goes as a fragment of its own, by its own hash
   instead, which spreads a hot anchor over all blocks.
5. ``_solve``: the operator's solver gets the fragments of each anchor, those of several documents as two occurrences, of the smallest and of a
   later document, and finds the stretches that also occur in a smaller document; all later places of a fragment share the second's. Answers go back by partition.
6. ``_finish``: each partition merges the answers of its texts.

What a task holds is bounded by the partition (P grows with the bytes of the corpus), as a partition has each
hash and each fragment once, however often a passage occurs. Blocks are ranges of scrambled hashes: an anchor is the least hash of
its window, so that ranges of the hashes themselves would put nearly all anchors into the first blocks. A partition sends a block one row for all
it has, so there are never more rows than anchors.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import PAD, U, Words, binary_column, loads, mix, pack_ints, pack_sorted, ragged, release, slices, unpack_ints, unpack_sorted, winnow, xxh64
from .common import only, width

#: Bytes of text that a partition holds, about.
PARTITION_BYTES = 8 << 20
#: Occurrences beyond which an anchor's windows travel one by one.
HOT = 10_000
#: Bytes of differing fragments that a solver gets at once, about; the fragments of an anchor stay together.
SOLVE_BYTES = 1 << 18
#: Bytes of text whose units are held as arrays at once (some hundred bytes each).
LOAD_BYTES = 1 << 19
#: Rows whose texts are packed together.
PACK_ROWS = 2500
SIGN = np.int64(-(2**63))


class Loaded:
    """Texts as one run of units. first: each text's first unit, and the total; grams: a hash of the units at each position."""

    def __init__(self, buffer: bytes, first: np.ndarray, grams: np.ndarray, start: np.ndarray | None, length: np.ndarray | None):
        self.buffer, self.first, self.grams = buffer, first, grams
        self._start, self._length = start, length

    def span(self, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset and length of ``count`` units from ``begin`` on."""
        if self._start is None:
            return begin, count
        last = begin + count - 1
        return self._start[begin], self._start[last] + self._length[last] - self._start[begin]


@dataclass(frozen=True)
class ByteUnits:
    window: int = 50
    gram: int = 16

    def load(self, texts: list[bytes]) -> Loaded:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        buffer = b"".join(texts) + PAD + PAD
        with np.errstate(over="ignore"):
            wide = loads(buffer)
            h = wide[:-8] * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
            h = (h + wide[8:]) * U(0xC2B2AE3D27D4EB4F)
            h ^= h >> U(32)
        return Loaded(buffer, np.concatenate([[0], np.cumsum(size)]), h, None, None)

    def count(self, text: bytes) -> int:
        return len(text)

    def kept(self, text: bytes, gone: np.ndarray) -> bytes:
        return np.frombuffer(text, np.uint8)[~gone].tobytes()

    def whole(self, text: bytes) -> bytes:
        return text


@dataclass(frozen=True)
class WordUnits:
    window: int = 50
    gram: int = 8

    def load(self, texts: list[bytes]) -> Loaded:
        w = Words(texts)
        words = word_hashes(w)
        h = np.zeros(max(0, len(words) - self.gram + 1), U)
        with np.errstate(over="ignore"):
            for j in range(self.gram):
                h = h * U(0x9E3779B97F4A7C15) + words[j : j + len(h)]
        return Loaded(w.buffer, w.first, mix(h), w.start, w.length)

    def count(self, text: bytes) -> int:
        return len(text.split())

    def kept(self, text: bytes, gone: np.ndarray) -> bytes:
        return b" ".join(itertools.compress(text.split(), ~gone))

    def whole(self, text: bytes) -> bytes:
        return b" ".join(text.split())


def word_hashes(w: Words) -> np.ndarray:
    return xxh64(w.buffer, w.start, w.length, 7)


@dataclass
class Anchors:
    """Chosen positions of some texts: hash, and the windows [low, high] (unit positions) that hold each as their least gram."""

    loaded: Loaded
    at: np.ndarray
    hash: np.ndarray
    text: np.ndarray


def anchors(units, texts: list[bytes]) -> Anchors:
    data = units.load(texts)
    count = np.maximum(np.diff(data.first) - units.window + 1, 0)
    order = (data.grams >> U(33)).astype(np.uint32)
    at = winnow(order, data.first[:-1], count, units.window - units.gram + 1)
    text = np.searchsorted(data.first, at, side="right") - 1
    return Anchors(data, at, mix(data.grams[at]), text)


def windows_of(units, a: Anchors, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of the picked anchors that hold them as their least gram; the windows between do, too."""
    order = (a.loaded.grams >> U(33)).astype(np.uint32)
    reach = units.window - units.gram + 1
    at, text = a.at[pick], a.text[pick]
    first, stop = a.loaded.first[text], a.loaded.first[text + 1]
    own = order[at]
    left, right = at.copy(), at.copy()  # grams from left to right are none smaller than the anchor
    for step, edge in ((-1, left), (1, right)):
        live = np.arange(len(at))
        for _ in range(reach - 1):
            nxt = edge[live] + step
            ok = (nxt >= first[live]) & (nxt <= stop[live] - units.gram)
            ok &= order[np.clip(nxt, 0, len(order) - 1)] >= own[live]
            live, nxt = live[ok], nxt[ok]
            edge[live] = nxt
    return np.maximum(left, at - reach + 1), np.minimum(at, right - reach + 1)


# --- blocks -----------------------------------------------------------------------------------------------------


#: Stands for no second id; a document with this id takes part as a smallest one only.
NONE = 2**63 - 1


def _add(texts: dict[bytes, list], key: bytes, text: bytes, least: int, second: int) -> None:
    """Keeps the two smallest ids of each text."""
    known = texts.get(key)
    if known is None:
        texts[key] = [least, second, text]
    else:
        known[:2] = (sorted({known[0], known[1], least, second}) + [NONE])[:2]


def _pack(partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for rows in (batch.slice(i, PACK_ROWS) for batch in batches for i in range(0, len(batch), PACK_ROWS)):
            by: dict[int, dict[bytes, list]] = {}
            for doc_id, text in zip(rows.column(0).to_pylist(), binary_column(rows.column(1)), strict=True):
                key = hashlib.md5(text, usedforsecurity=False).digest()
                _add(by.setdefault(int.from_bytes(key[:4], "big") % partitions, {}), key, text, doc_id, NONE)
            for part, texts in by.items():
                keys, docs = list(texts), list(texts.values())
                for i, j in slices([len(t) for *_, t in docs]):
                    some = docs[i:j]
                    blobs = (b"".join(keys[i:j]), np.array([x[:2] for x in some], np.int64).tobytes(), pack_ints(np.array([len(x[2]) for x in some])), zip_.compress(b"".join(x[2] for x in some)))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["part", "keys", "ids", "sizes", "texts"])
            del by
            release()

    return run


def blocks(docs: DataFrame, partitions: int) -> DataFrame:
    packed = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_pack(partitions), "part int, keys binary, ids binary, sizes binary, texts binary")
    return packed.repartition(partitions, "part").persist(StorageLevel.DISK_ONLY)


def _unpack(table: pa.Table) -> tuple[list[bytes], list[int], list[bytes], list[bool]]:
    """Keys, smallest ids and texts of a partition, and whether another id has the text, by key: the same order at every reading."""
    found: dict[bytes, list] = {}
    unzip = zstandard.ZstdDecompressor()
    for keys, ids, sizes, texts in zip(*(table.column(c).to_pylist() for c in ("keys", "ids", "sizes", "texts")), strict=True):
        raw, at = unzip.decompress(texts), 0
        for k, ((least, second), n) in enumerate(zip(np.frombuffer(ids, np.int64).reshape(-1, 2).tolist(), unpack_ints(sizes).tolist(), strict=True)):
            _add(found, keys[16 * k : 16 * k + 16], raw[at : at + n], least, second)
            at += n
    order = sorted(found)
    return order, [found[k][0] for k in order], [found[k][2] for k in order], [found[k][1] < NONE for k in order]


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal hash ranges begins in ascending hashes, and the end."""
    bounds = np.array([(i << 64) // parts for i in range(parts)], U)
    return np.append(np.searchsorted(hashes, bounds), len(hashes))


# --- offers and answers -----------------------------------------------------------------------------------------

#: Low bits of an anchor's hash that are dropped on the way; a false meeting only costs a fragment's way.
DROP = 16


def _offer(units, parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        _, _, texts, _ = _unpack(table)
        seen, several = [], []
        for i, j in slices([len(t) for t in texts], LOAD_BYTES):
            a = anchors(units, texts[i:j])
            order = np.lexsort((a.text, a.hash >> U(DROP)))
            h, t = (a.hash >> U(DROP))[order], a.text[order]
            new = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0) if len(h) else np.zeros(0, np.int64)
            if len(new):
                seen.append(h[new])
                several.append(np.diff(np.append(new, len(h))) | ((np.maximum.reduceat(t, new) != np.minimum.reduceat(t, new)).astype(np.int64) << 40))
        rows = []
        if seen:
            h, n = np.concatenate(seen), np.concatenate(several)
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            new = np.flatnonzero(np.diff(h, prepend=h[0] + U(1)) != 0)
            # shared within the partition: by two slices, which never share a text, or by two texts of one
            own = (np.add.reduceat(n >> 40, new) > 0) | (np.diff(np.append(new, len(h))) > 1)
            total = np.add.reduceat(n & ((1 << 40) - 1), new)
            h = h[new]
            code = np.minimum(np.frexp(total.astype(float))[1], 100) | own.astype(np.int64) << 7
            cut = _ranges(h << U(DROP), parts)
            for b in range(parts):
                if cut[b] < cut[b + 1]:
                    rows.append((b, part, pack_sorted(h[cut[b] : cut[b + 1]]), pack_ints(code[cut[b] : cut[b + 1]])))
        return _table(rows, "block int, part int, hashes binary, codes binary")

    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    release()
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _share(hot: int):
    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        hashes = [unpack_sorted(b) for b in table.column("hashes").to_pylist()]
        codes = np.concatenate([unpack_ints(b) for b in table.column("codes").to_pylist()]).astype(np.int64)
        h = np.concatenate(hashes)
        source = np.repeat(np.arange(len(parts)), [len(x) for x in hashes])
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] + U(1)) != 0)
        size = np.diff(np.append(new, len(h)))
        c = codes[order]
        shared = (size > 1) | (np.maximum.reduceat(c, new) >= 128)
        many = np.add.reduceat(1 << np.minimum(np.maximum((c & 127) - 1, 0), 40), new) > hot
        flag = np.zeros(len(h), np.int64)
        flag[order] = np.repeat(np.where(shared, 1 + many, 0), size)
        rows = []
        for i, part in enumerate(parts):
            mine = slice(*np.searchsorted(source, [i, i + 1]))
            f = flag[mine]
            if f.any():
                rows.append((part, pack_sorted(h[mine][f > 0]), pack_ints(f[f > 0])))
        return _table(rows, "part int, hashes binary, flags binary")

    return run


FRAGMENTS = "block int, part int, keys binary, units binary, sizes binary, texts binary, places binary, docs binary, starts binary, ids binary"


def _send(units, parts: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows: list[tuple] = []
        if not len(right) or not len(left):
            return _table(rows, FRAGMENTS)
        _, ids, texts, _ = _unpack(left)
        told = np.concatenate([unpack_sorted(b) for b in right.column("hashes").to_pylist()])
        flags = np.concatenate([unpack_ints(b) for b in right.column("flags").to_pylist()])
        order = np.argsort(told)
        told, flags = told[order], flags[order]
        got: list[tuple] = []
        for i, j in slices([len(t) for t in texts], LOAD_BYTES):
            a = anchors(units, texts[i:j])
            short = a.hash >> U(DROP)
            at = np.minimum(np.searchsorted(told, short), len(told) - 1)
            pick = np.flatnonzero(told[at] == short)
            if not len(pick):
                continue
            low, high = windows_of(units, a, pick)
            key_, text = a.hash[pick], a.text[pick]
            many = flags[at[pick]] == 2
            if many.any():  # each window on its own
                n = (high - low + 1)[many]
                low = np.concatenate([low[~many], ragged(low[many], n)])
                high = np.concatenate([high[~many], low[len(low) - n.sum() :]])
                text = np.concatenate([text[~many], np.repeat(text[many], n)])
                key_ = key_[~many]
            data, count = a.loaded, high - low + units.window
            start, size = data.span(low, count)
            same = xxh64(data.buffer, start, size, 1)
            lone = np.arange(len(low)) >= len(key_)
            key_ = np.concatenate([key_, mix(same[lone])])
            # keep one text of each (key, content)
            order = np.lexsort((same, key_))
            k, s = key_[order], same[order]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
            rep = order[new]
            content = [data.buffer[x : x + y] for x, y in zip(start[rep].tolist(), size[rep].tolist(), strict=True)]
            got.append((k[new], s[new], count[rep], content, np.diff(np.append(new, len(order))), (i + text[order]).astype(np.int32), (low - data.first[text])[order].astype(np.int32)))
        if not got:
            return _table(rows, FRAGMENTS)
        k, s, count = (np.concatenate([g[x] for g in got]) for x in range(3))
        content = [c for g in got for c in g[3]]
        n = np.concatenate([g[4] for g in got])
        begin = np.cumsum(n) - n
        docs, starts = (np.concatenate([g[x] for g in got]) for x in (5, 6))
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
        places = ragged(begin[order], n[order])
        docs, starts = docs[places], starts[places]
        del places, got, begin
        own = np.array(ids, np.int64)[docs]
        total = np.add.reduceat(n[order], new)
        upto = np.concatenate([[0], np.cumsum(total)])
        rep = order[new]
        k = k[new]
        cut = _ranges(k, parts)
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in range(parts):
            x, y = cut[b], cut[b + 1]
            if x == y:
                continue
            some = [content[r] for r in rep[x:y]]
            p, q = upto[x], upto[y]
            rows.append((b, part, pack_sorted(k[x:y]), pack_ints(count[rep[x:y]]), pack_ints(np.array([len(c) for c in some])), zip_.compress(b"".join(some)), pack_ints(total[x:y]), pack_ints(docs[p:q]), pack_ints(starts[p:q]), pack_ints((own[p:q] ^ SIGN).view(U))))
        return _table(rows, FRAGMENTS)

    return run


#: Solver of fragments: (texts, group of each, smallest id of each, second id or NONE) -> (fragment, first unit, end unit) of the stretches
#: of at least a window that also occur in a fragment of the same group with a smaller id; fragment len(texts) + i is text i with its second id.
Solver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _solve(solver: Solver):
    def run(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        parts = col["part"]
        keys = [unpack_sorted(b) for b in col["keys"]]
        k = np.concatenate(keys)
        raw = [unzip.decompress(b) for b in col["texts"]]
        n_units, size, places = (np.concatenate([unpack_ints(b) for b in col[c]]).astype(np.int64) for c in ("units", "sizes", "places"))
        docs, starts = (np.concatenate([unpack_ints(b) for b in col[c]]).astype(np.int32) for c in ("docs", "starts"))
        ids = np.concatenate([unpack_ints(b) for b in col["ids"]]).view(np.int64) ^ SIGN
        part_of = np.repeat(np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in keys]), places)
        buffer = b"".join(raw) + PAD
        at = np.cumsum(size) - size
        del raw, table, keys
        for c in list(col):
            if c != "part":
                del col[c]
        same = xxh64(buffer, at, size, 3)
        order = np.lexsort((same, k))
        ks, ss = k[order], same[order]
        new = np.concatenate([[True], (ks[1:] != ks[:-1]) | (ss[1:] != ss[:-1])])
        kind = np.zeros(len(k), np.int32)  # of each row, its distinct fragment
        kind[order] = np.cumsum(new) - 1
        rep = order[new]
        group = np.cumsum(np.concatenate([[True], ks[new][1:] != ks[new][:-1]])) - 1
        fragment = np.repeat(kind, places)
        least, second = (np.full(len(rep), np.iinfo(np.int64).max) for _ in range(2))
        np.minimum.at(least, fragment, ids)
        later = ids > least[fragment]
        np.minimum.at(second, fragment[later], ids[later])
        # the solver sees the fragments of each anchor together; one of several documents occurs twice
        of_place = fragment + np.where(later, len(rep), 0)
        several = np.flatnonzero((np.bincount(group, 1 + (second < NONE)) > 1)[group])
        found = []
        if len(several):
            g = group[several]
            edge = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g))
            weight = np.add.reduceat(size[rep[several]], edge[:-1])
            for i, j in slices(weight.tolist(), SOLVE_BYTES):
                some = several[edge[i] : edge[j]]
                of = rep[some]
                texts = [buffer[a : a + n] for a, n in zip(at[of].tolist(), size[of].tolist(), strict=True)]
                f, x, y = solver(texts, group[some], least[some], second[some])
                found.append((np.concatenate([some, len(rep) + some])[f], x, y))
        rows: list[tuple] = []
        if not found:
            return _table(rows, "part int, docs binary, starts binary, lengths binary")
        f, x, y = (np.concatenate([c[i] for c in found]) for i in range(3))
        order = np.argsort(f, kind="stable")
        f, x, y = f[order], x[order], y[order]
        lo, hi = np.searchsorted(f, of_place), np.searchsorted(f, of_place, side="right")
        which = ragged(lo, hi - lo)
        place = np.repeat(np.arange(len(of_place)), hi - lo)
        x, y = starts[place] + x[which], starts[place] + y[which]
        order = np.lexsort((x, docs[place], part_of[place]))
        place, x, y = place[order], x[order], y[order]
        cut = np.searchsorted(part_of[place], np.arange(len(parts) + 1))
        for i, part in enumerate(parts):
            a, b = cut[i], cut[i + 1]
            if a < b:
                rows.append((part, pack_ints(docs[place[a:b]]), pack_ints(x[a:b]), pack_ints(y[a:b] - x[a:b])))
        return _table(rows, "part int, docs binary, starts binary, lengths binary")

    return run


RESULT = "key binary, least long, n long, n_removed long, starts array<long>, ends array<long>, kept binary, copy_removed long, copy_starts array<long>, copy_ends array<long>, copy_kept binary"


def _second_copies(units, solver: Solver, texts: list[bytes], several: list[bool]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The stretches that a second copy of each text with ``several`` ids loses to the first."""
    out = {}
    some = [i for i, x in enumerate(several) if x]
    for a, b in slices([len(texts[i]) for i in some], SOLVE_BYTES):
        mine = some[a:b]
        f, x, y = solver([texts[i] for i in mine], np.arange(len(mine)), np.zeros(len(mine), np.int64), np.ones(len(mine), np.int64))
        for k, i in enumerate(mine):
            lost = f == len(mine) + k
            out[i] = (x[lost], y[lost])
    return out


def _removed(units, text: bytes, count: int, starts: np.ndarray, ends: np.ndarray, keep: str) -> tuple[int, list[int], list[int], bytes]:
    """Units removed, the maximal runs of them, and what is kept."""
    if len(starts):
        cover = np.bincount(starts, minlength=count + 1) - np.bincount(ends, minlength=count + 1)
        gone = np.cumsum(cover[:count]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        rest = units.kept(text, gone)
    else:
        gone, edges = np.zeros(1, bool), np.zeros(0, np.int64)
        rest = text if keep == "text" else units.whole(text)
    return int(gone.sum()), edges[::2].tolist(), edges[1::2].tolist(), hashlib.sha256(rest).digest() if keep == "digest" else rest


def _finish(units, solver: Solver, keep: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, texts, several = _unpack(left)
        docs = starts = lengths = np.zeros(0, np.int64)
        if len(right):
            docs, starts, lengths = (np.concatenate([unpack_ints(b) for b in right.column(c).to_pylist()]).astype(np.int64) for c in ("docs", "starts", "lengths"))
            order = np.argsort(docs, kind="stable")
            docs, starts, lengths = docs[order], starts[order], lengths[order]
        cut = np.searchsorted(docs, np.arange(len(keys) + 1))
        copies = _second_copies(units, solver, texts, several)
        rows = []
        for i, text in enumerate(texts):
            count = units.count(text)
            a, b = cut[i], cut[i + 1]
            mine = _removed(units, text, count, starts[a:b], starts[a:b] + lengths[a:b], keep)
            rows.append((keys[i], ids[i], count, *mine, *(_removed(units, text, count, *copies[i], keep) if several[i] else (None,) * 4)))
        release()
        kinds = (pa.binary(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2, pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.binary())
        return pa.table([pa.array(c, kind) for c, kind in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def repeated(docs: DataFrame, units, solver: Solver, keep: str = "units", hot: int = HOT, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """key (MD5 of the text), least (smallest doc_id with it), n units, n_removed, starts and ends of the maximal removed runs, kept.

    One row for each distinct text of ``docs`` (doc_id, text) with a doc_id, judged as the document ``least``: removed is every
    unit covered by a window that also starts in a document with a smaller id. kept: the units left, if ``keep`` is "units"; their SHA-256,
    if "digest"; if "text", the units left of a text that loses any, else the text as it is. The columns from copy_removed on say the same of all later documents with the text; null if there are none.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = width(spark, total, partition_bytes)
    held = blocks(docs, parts)
    offers = held.groupBy("part").applyInArrow(_offer(units, parts), "block int, part int, hashes binary, codes binary")
    shared = offers.repartition(parts, "block").groupBy("block").applyInArrow(_share(hot), "part int, hashes binary, flags binary")
    sent = held.groupBy("part").cogroup(shared.repartition(parts, "part").groupBy("part")).applyInArrow(_send(units, parts), FRAGMENTS)
    told = sent.repartition(parts, "block").groupBy("block").applyInArrow(_solve(solver), "part int, docs binary, starts binary, lengths binary")
    return held.groupBy("part").cogroup(told.repartition(parts, "part").groupBy("part")).applyInArrow(_finish(units, solver, keep), RESULT)


def text_key(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
