"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A document's 64-bit fingerprint has a bit set where over half of the XXH64 values (seed 42) of its word
shingles have it. Fingerprints at ``DISTANCE`` or fewer differing bits are linked; connected documents
form a class.

Finding the links. The bits are cut into segments A (23 bits), B (23) and C (18). The perfect Golay code
(23, 12) has a codeword within three bits of any 23-bit word; the codewords within *four* bits of a word are
one or six, and two words at distance two or less always have one in common (that nearest to their
midpoint). For at most four errors (a, b, c) over the segments,

* a <= 2 and b <= 2: A and B have a codeword in common each, so a pair of codewords is shared;
* a >= 3, so b + c <= 1: B is equal, or C is equal and B has a codeword in common;
* b >= 3: the same with A and B exchanged.

So a fingerprint gets up to 50 keys (41 on average), and any two linked fingerprints share one. The distinct
fingerprints meet by key; each bucket is searched by numpy popcounts and gives a spanning forest of
its links, never all pairs. Buckets above ``BUCKET`` fingerprints are dealt out anew as pairs of blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import Words, binary_column, ragged, slices, xxh64
from .common import numbered, only, stash, width
from .components import LINK, components, forest

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of a bucket that one task compares at most.
BUCKET = 4096
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprints(docs: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint of each text; A-Z are lower-cased, a text without words gives zero."""
    out = np.zeros(len(docs), np.uint64)
    for i, j in slices([len(d) for d in docs]):
        w = Words([d.lower() for d in docs[i:j]])
        n_words = np.diff(w.first)
        n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
        head = ragged(w.first[:-1], n)
        if not len(head):
            continue
        last = head + np.repeat(np.minimum(n_words, shingle) - 1, n)
        h = xxh64(w.buffer, w.start[head], w.start[last] + w.length[last] - w.start[head], SEED)
        out[i:j][n > 0] = _majority(h, n[n > 0])
    return out


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run of n[i] hashes, the bits that over half of them have."""
    # bits are counted in the eight byte lanes of an integer, over at most 255 hashes at a time
    parts = -(-n // 255)
    start = np.cumsum(n) - n
    cut = np.repeat(start, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    group = np.cumsum(parts) - parts
    out = np.zeros(len(n), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), cut)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), group, axis=0)
        for byte in range(8):
            out |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _add_fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fingerprints(binary_column(batch.column(1)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "fp"])

    return run


class Golay:
    """The codewords near 23-bit words, by table look-up."""

    def __init__(self):
        patterns = [0] + [sum(1 << b for b in bits) for k in range(1, 5) for bits in itertools.combinations(range(23), k)]
        by: list[list[int]] = [[] for _ in range(1 << 11)]
        for p, s in zip(patterns, self.syndrome(np.array(patterns)), strict=True):
            by[s].append(p)
        self.errors = np.array([x + [-1] * (6 - len(x)) for x in by])

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        """Remainder by the generator polynomial; zero for codewords."""
        rest = words.astype(np.int64)
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
        return rest

    def near(self, words: np.ndarray) -> np.ndarray:
        """(n, 6): indices (12 bits) of all codewords within four bits of each word, then -1."""
        errors = self.errors[self.syndrome(words)]
        return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


_golay: Golay | None = None


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, key) of all keys of each fingerprint; any two within four bits share a key."""
    global _golay
    _golay = _golay or Golay()
    fp = fp.astype(np.uint64)
    a, b, c = ((fp >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in ((0, 23), (23, 23), (46, 18)))
    near_a, near_b = _golay.near(a), _golay.near(b)
    table = [np.where((near_a[:, i] >= 0) & (near_b[:, j] >= 0), near_a[:, i] << 12 | near_b[:, j], -1) for i in range(6) for j in range(6)]
    table += [1 << 32 | a, 2 << 32 | b]
    table += [np.where(near[:, i] >= 0, kind << 32 | c << 12 | near[:, i], -1) for kind, near in ((3, near_a), (4, near_b)) for i in range(6)]
    got = np.stack(table, axis=1)
    row, col = np.nonzero(got >= 0)
    return row, got[row, col]


def _add_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 8192):
            row, key = keys(fp[i : i + 8192].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 8192][row])], names=["key", "fp"])


def linked(fp: np.ndarray, run: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run; ``run`` ascends."""
    begin = np.flatnonzero(np.diff(run, prepend=run[0] - 1)) if len(run) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(run)))
    found_a, found_b = [], []
    small = size <= 16
    at = ragged(begin[small], size[small])
    x, r = fp[at], run[at]
    for d in range(1, int(size[small].max(initial=1))):
        same = np.flatnonzero(r[d:] == r[:-d])
        near = same[np.bitwise_count((x[same + d] ^ x[same]).view(np.uint64)) <= distance]
        found_a.append(x[near])
        found_b.append(x[near + d])
    for s, n in zip(begin[~small], size[~small], strict=True):
        rest = fp[s : s + n]
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                v = queue.pop()
                near = np.bitwise_count((rest ^ v).view(np.uint64)) <= distance
                if near.any():
                    new = rest[near]
                    found_a.append(new)
                    found_b.append(np.full(len(new), v))
                    queue.extend(new)
                    rest = rest[~near]
    if not found_a:
        return fp[:0], fp[:0]
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _search(distance: int, most: int | None):
    """Streams rows (key, fp) sorted by key. Emits (kind, a, b): kind 0 a link, kind 1 a row (key, fp) of a bucket over ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)
        a = b = np.zeros(0, np.int64)
        put_off = None

        def out(kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], names=["kind", "a", "b"])

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
                fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            if put_off is not None and key[0] == put_off:
                n = np.searchsorted(key, put_off, "right")
                yield out(1, key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
            n = len(key) if batch is None or not len(key) else np.searchsorted(key, key[-1])
            whole, part, key, fp = key[:n], fp[:n], key[n:], fp[n:]
            if most is not None and len(whole):
                starts = np.flatnonzero(np.diff(whole, prepend=whole[0] - 1))
                size = np.diff(np.append(starts, len(whole)))
                large = np.repeat(size > most, size)
                if large.any():
                    yield out(1, whole[large], part[large])
                    whole, part = whole[~large], part[~large]
            if len(whole):
                x, y = linked(part, whole, distance)
                a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
                if len(a) > 1 << 18:
                    yield out(0, a, b)
                    a = b = a[:0]
            if most is not None and len(key) > most:
                put_off = key[0]
                yield out(1, key, fp)
                key, fp = key[:0], fp[:0]
        if len(a):
            yield out(0, a, b)

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a spanning forest of the links between the fingerprints in column fp (distinct, not null).

    Links of any two fingerprints at ``distance`` (four at most) or fewer bits connect them.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the keys find at most {DISTANCE} differing bits")
    spark = distinct.sparkSession
    n = width(spark)
    keyed = distinct.select("fp").mapInArrow(_add_keys, "key long, fp long")
    first = stash(keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_search(distance, bucket), "kind int, a long, b long"))
    found = first.where("kind = 0").select("a", "b")
    large = first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if large.isEmpty():
        return found
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(bucket)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = (
        large.join(blocks, "key")
        .select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
    )
    again = pairs.repartition(4 * n, "key").sortWithinPartitions("key", "fp").mapInArrow(_search(distance, None), "kind int, a long, b long")
    return found.union(again.select("a", "b"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (long), root (long), component_id of every row of ``docs`` (doc_id, text).

    root is the least fingerprint (as a signed number) of the component, component_id the smallest doc_id.
    Null and empty texts, and those without words, have fingerprint zero and are linked like any other.
    Texts of any length are hashed whole, in memory in proportion to the longest.
    A null doc_id takes part but is never the smallest; a component of such rows alone has a null id. Repeated
    rows give repeated results. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stash(only(docs, "doc_id", "text").mapInArrow(_add_fingerprints(shingle), "doc_id long, fp long"))
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tree = stash(components(links(distinct, distance, bucket)).toDF("fp", "root"))
    marked = distinct.join(tree, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = stash(marked.join(marked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "root", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` less all but one document of each class: that of the smallest doc_id stays, in all its rows.

    Rows without a doc_id can't be told apart and stay; so do all rows of an id that is the smallest of any class, where
    an id has several texts. All columns are kept as they are.
    """
    got = simhash_groups(docs, **options)
    leads = F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("leads")
    gone = stash(got.where("doc_id is not null").groupBy(F.col("doc_id").alias("_gone")).agg(leads).where("not leads").select("_gone"))
    flat, (doc_id,) = numbered(docs, "doc_id")
    return flat.join(gone, flat[doc_id] == gone["_gone"], "left_anti").toDF(*docs.columns)
