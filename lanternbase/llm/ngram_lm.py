"""Cross-entropy difference scoring by matched n-gram models.

Two bigram models, of a target corpus and of the whole corpus as background, have the same vocabulary (the words of the background),
order and smoothing. A document's score is its mean per-token loss under the target model less that under the background
model: the lower, the more it is like the target. Neither model counts the document that it scores: a row's own words are taken from the
counts first, so that a document of the target is not the likelier for being in it.

Counts are exact over all documents. Partitions of documents offer each distinct unigram and bigram hash (64 bits) once with its two
counts, packed; blocks by hash range sum them and answer each partition in the order it asked, so that answers hold counts
only. What a task holds is bounded by the partition, whose number grows with the corpus; a frequent word is one entry
a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, Words, binary_column, mix, pack_ints, pack_sorted, release, slices, unpack_ints, unpack_sorted
from .common import only, stash, width
from .repeats import _ranges, _table, word_hashes

#: Add-alpha smoothing of unigrams, and the weight of the unigram estimate in bigrams.
ALPHA, MU = 0.5, 5.0
PARTITION_BYTES = 8 << 20
START, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
HELD = "part int, ids array<long>, sizes binary, texts binary"
ROWS = 2500


def _pack():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for rows in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            ids, texts = rows.column(0).to_pylist(), binary_column(rows.column(1))
            where = rows.column(2).to_numpy()
            for p in np.unique(where):
                some = np.flatnonzero(where == p)
                mine = [texts[i] for i in some]
                for a, b in slices([len(t) for t in mine]):
                    blobs = (pack_ints(np.array([len(t) for t in mine[a:b]])), zip_.compress(b"".join(mine[a:b])))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([[ids[i] for i in some[a:b]]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs)], names=["part", "ids", "sizes", "texts"])
            release()

    return run


def _unpack(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and lower-cased texts, in an order that does not depend on how the rows arrived."""
    unzip = zstandard.ZstdDecompressor()
    found = []
    for ids, sizes, texts in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "texts")), strict=True):
        raw, at = unzip.decompress(texts), 0
        for doc_id, n in zip(ids, unpack_ints(sizes).tolist(), strict=True):
            found.append((doc_id is None, doc_id or 0, raw[at : at + n].lower()))
            at += n
    found.sort()
    return [None if null else d for null, d, _ in found], [t for _, _, t in found]


class Grams:
    """Unigrams and bigrams of texts as hashes; the lowest bit is 1 for unigrams. Each text is followed by an end, after a start."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        n = np.diff(w.first)
        self.tokens = n + 1
        self.text = np.repeat(np.arange(len(texts)), self.tokens)
        ends = np.cumsum(self.tokens) - 1
        inside = np.ones(int(self.tokens.sum()), bool)
        inside[ends] = False
        word = np.empty(len(inside), U)
        word[inside] = word_hashes(w)
        word[ends] = END
        before = np.concatenate([[START], word[:-1]]) if len(word) else word
        before[ends - n] = START
        with np.errstate(over="ignore"):
            self.word = mix(word) | U(1)
            self.context = mix(before) | U(1)
            self.pair = mix(before * U(0x9E3779B97F4A7C15) + word) & ~U(1)


def _offer(parts: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        wanted = {x for row in right.column("target_ids").to_pylist() for x in row}
        ids, texts = _unpack(left)
        grams = Grams(texts)
        target = np.array([d in wanted for d in ids], bool)[grams.text]
        first = np.flatnonzero(grams.context == (mix(np.array([START])) | U(1))[0])
        # starts are counted as contexts only
        keys = np.concatenate([grams.word, grams.pair, grams.context[first]])
        flags = np.concatenate([target, target, target[first]])
        distinct, where = np.unique(keys, return_inverse=True)
        all_n, target_n = np.bincount(where), np.bincount(where, flags).astype(np.int64)
        cut = _ranges(distinct, parts)
        rows = [(b, part, pack_sorted(distinct[cut[b] : cut[b + 1]]), pack_ints(all_n[cut[b] : cut[b + 1]]), pack_ints(target_n[cut[b] : cut[b + 1]])) for b in range(parts) if cut[b] < cut[b + 1]]
        return _table(rows, "block int, part int, keys binary, n_all binary, n_target binary")

    return run


ANSWER = "part int, block int, n_all binary, n_target binary, vocabulary long, tokens_all long, tokens_target long"


def _sum(table: pa.Table) -> pa.Table:
    parts, block = table.column("part").to_pylist(), table.column("block")[0].as_py()
    keys = [unpack_sorted(b) for b in table.column("keys").to_pylist()]
    n_all, n_target = (np.concatenate([unpack_ints(b) for b in table.column(c).to_pylist()]).astype(np.int64) for c in ("n_all", "n_target"))
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total_all, total_target = (np.bincount(where, n).astype(np.int64) for n in (n_all, n_target))
    # the vocabulary holds the words and the end; the start is a context only
    words = ((distinct & U(1)) == 1) & (distinct != (mix(np.array([START])) | U(1))[0])
    rows = [(-1, block, b"", b"", int(words.sum()), int(total_all[words].sum()), int(total_target[words].sum()))]
    at = 0
    for part, k in zip(parts, keys, strict=True):
        mine = where[at : at + len(k)]
        rows.append((part, block, pack_ints(total_all[mine]), pack_ints(total_target[mine]), None, None, None))
        at += len(k)
    return _table(rows, ANSWER)


def _loss(count_pair, count_word, count_context, tokens, vocabulary: int) -> np.ndarray:
    """Negative log probability of each token given the one before."""
    unigram = (count_word + ALPHA) / (tokens + ALPHA * max(1, vocabulary))
    return -np.log((count_pair + MU * unigram) / (count_context + MU))


def _own(text: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """How often each token's gram (a number below ``n``) occurs in the token's text."""
    _, where, count = np.unique(text * n + gram, return_inverse=True, return_counts=True)
    return count[where]


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _score(totals: tuple[int, int, int]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vocabulary, tokens_all, tokens_target = totals
        ids, texts = _unpack(left)
        grams = Grams(texts)
        first = np.flatnonzero(grams.context == (mix(np.array([START])) | U(1))[0])
        distinct = np.unique(np.concatenate([grams.word, grams.pair, grams.context[first]]))
        block = right.column("block").to_numpy()
        order = [i for i in np.argsort(block) if block[i] >= 0]
        counts = [np.concatenate([unpack_ints(right.column(c)[int(i)].as_py()) for i in order]).astype(np.float64) for c in ("n_all", "n_target")]
        wanted = {x for row in right.column("target_ids").to_pylist() if row for x in row}
        target = np.array([d in wanted for d in ids], np.int64)
        at = [np.searchsorted(distinct, g) for g in (grams.pair, grams.word, grams.context)]
        own = [_own(grams.text, g, len(distinct)) for g in at]
        n = grams.tokens
        losses = []
        for c, tokens, counted in zip(counts, (tokens_all, tokens_target), (np.ones(len(texts), np.int64), target), strict=True):
            less = counted[grams.text]
            loss = _loss(*(c[i] - less * o for i, o in zip(at, own, strict=True)), tokens - less * n[grams.text], vocabulary)
            losses.append(np.bincount(grams.text, loss, len(texts)) / n)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n), "target_loss": pa.array(losses[1]), "background_loss": pa.array(losses[0]), "score": pa.array(losses[1] - losses[0])})

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of ``docs`` (doc_id, text).

    ``target`` (doc_id) names the documents of the target corpus; ids that are null, repeated or in no document change nothing.
    Words are runs of characters other than white space, A-Z lower-cased; each text ends with an end token, so
    null and empty texts have one token. A null doc_id belongs to the background only. Repeated rows count as often as they
    occur, and a row leaves out itself only, not its copies; the vocabulary is that of all rows. A text of any
    length is scored whole; it is not split, so the task that counts it holds some hundred bytes for each of its tokens at once. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = width(spark, total, partition_bytes)
    # a null id's rows are dealt by their texts
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))), F.lit(parts)).cast("int")
    held = docs.select("doc_id", "text", part.alias("part")).mapInArrow(_pack(), HELD).repartition(parts, "part").persist(StorageLevel.DISK_ONLY)
    chosen = only(target, "doc_id").where("doc_id is not null").distinct()
    part_of = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts)).cast("int").alias("part")
    chosen = stash(chosen.groupBy(part_of).agg(F.collect_list("doc_id").alias("target_ids")))
    offers = held.groupBy("part").cogroup(chosen.repartition(parts, "part").groupBy("part")).applyInArrow(_offer(parts), "block int, part int, keys binary, n_all binary, n_target binary")
    answers = stash(offers.repartition(parts, "block").groupBy("block").applyInArrow(_sum, ANSWER))
    row = answers.where("part = -1").agg(F.sum("vocabulary"), F.sum("tokens_all"), F.sum("tokens_target")).first()
    totals = tuple(int(x or 0) for x in row)
    told = answers.where("part >= 0").select("part", "block", "n_all", "n_target", F.lit(None).cast("array<bigint>").alias("target_ids"))
    nothing = F.lit(None).cast("binary")
    told = told.union(chosen.select("part", F.lit(-1), nothing, nothing, "target_ids"))
    return held.groupBy("part").cogroup(told.repartition(parts, "part").groupBy("part")).applyInArrow(_score(totals), SCORES)
