"""Alignment of two tokenizers' tokens of the same texts.

Running sums of the tokens' byte lengths give their ends; ends that both sides share (an equi-join on text and end) cut a text into groups, and the running count of cuts is
a token's group. Tokens that end together are linked, and a link counts as often as its two ids are linked in the whole corpus.

Both tokenizers cut a text before each space that follows neither white space nor U+2581, so a text is a sequence of cells, each a space and what follows up to the next cut.
A task aligns each distinct cell once, all new ones of a batch together, and puts texts together from their cells. Rows of the texts and of their
chunk's distinct links leave the task; counts over the corpus and the best of each id are grouped and joined by Spark and come back to the chunk once for each link.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import ragged, release, slices
from .common import only, stash
from .tokens import Encoder, default_path, token_bytes

#: Bytes of text whose links are looked up together, and distinct cells that a worker keeps.
CHUNK, CELLS = 8 << 20, 200_000
#: Cells that the first side encodes as one text.
TOGETHER = 64
TEXTS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_odd = re.compile(" (?<=[\\s▁] )")
_cut = re.compile("(?<=[^\\s▁]) ")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cells(text: str) -> list[str]:
    """A text, cut at the spaces before which both tokenizers cut; the space of each cut is left out."""
    found = _cut.split(text) if text[:1] == " " or _odd.search(text) else text.split(" ")
    # a lone last space stays with the cell before it, as the piece library gives nothing for an empty text
    return found if found[-1] or len(found) == 1 else [*found[:-2], found[-2] + " "]


class Sides:
    """The two tokenizers: ids of cells, and the bytes of ids."""

    def __init__(self, byte_level: str, pieces: bytes):
        import json

        import sentencepiece

        self.first = Encoder(byte_level)
        self.first.tokenizer.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        spec = json.loads(byte_level)
        entries = {i: t for t, i in token_bytes(spec).items()} | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        size = self.second.get_piece_size()
        self.length_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.second.id_to_piece, range(size)))]

    def ids(self, found: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Flat ids and their number for each cell (with its space), of both sides."""
        lists = self.second.encode(found, num_threads=1)
        second = np.array(list(itertools.chain.from_iterable(lists)), np.int64)
        return [self._first_ids(found), (second, np.fromiter(map(len, lists), np.int64, len(lists)))]

    def _first_ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cells that end in no white space are encoded in blocks, as their ids stay apart; running byte lengths tell whose each id is."""
        joined = np.fromiter((c != "" and not c[-1].isspace() for c in found), bool, len(found))
        parts, counts, places = [], [], []
        for together in (True, False):
            at = np.flatnonzero(joined == together)
            some = [found[i] for i in at.tolist()]
            step = TOGETHER if together else 1
            flat, _ = self.first.ids(pa.array([f" {' '.join(some[i : i + step])}" for i in range(0, len(some), step)], pa.string()))
            bytes_ = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in some), np.int64, len(some)))
            owner = np.searchsorted(bytes_, np.cumsum(self.length_a[flat]))
            parts.append(flat.astype(np.int64))
            counts.append(np.bincount(owner, minlength=len(some))[: len(some)])
            places.append(at)
        if not len(places[1]):
            return parts[0], counts[0]
        # back to the order of the cells
        n = np.zeros(len(found), np.int64)
        for at, k in zip(places, counts, strict=True):
            n[at] = k
        flat = np.zeros(int(n.sum()), np.int64)
        begin = np.cumsum(n) - n
        for at, k, ids in zip(places, counts, parts, strict=True):
            flat[ragged(begin[at], k)] = ids[: int(k.sum())]
        return flat, n


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the tokens of either side, and the places of the tokens of either side that end together.

    ends: where tokens end, ascending, over one byte sequence.
    """
    cuts, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), at_a, at_b


class Known:
    """Aligned cells by number: whether both sides give back their bytes, numbers of tokens and groups, the groups as text, links as (id, id) codes."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (sides.bytes_a, sides.bytes_b))
        # each id before each of the three separators
        self.size = max(len(sides.bytes_a), len(sides.bytes_b))
        self.names = [f"{i}{sep}" for sep in ",|;" for i in range(self.size)]
        self.widths = np.fromiter(map(len, self.names), np.int64, len(self.names))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        # right, n_a, n_b, n_groups and the begin of the cell's links
        self.facts = np.zeros((0, 5), np.int64)
        self.codes = np.zeros(0, np.int64)

    def look_up(self, wanted: list[str]) -> np.ndarray:
        """Numbers of cells; new ones are aligned first."""
        new = list(dict.fromkeys(c for c in wanted if c not in self.number))
        for i, j in slices([len(c) + 8 for c in new], 1 << 22):
            self._add(new[i:j])
        return np.fromiter(map(self.number.__getitem__, wanted), np.int64, len(wanted))

    def _add(self, new: list[str]) -> None:
        (a, n_a), (b, n_b) = self.sides.ids(new)
        right = self._right(new, a, n_a, self.sides.bytes_a, self.length_a) & self._right(new, b, n_b, self.sides.bytes_b, self.length_b)
        # cells whose bytes differ make no tokens; the others follow each other, so that one pair of running sums serves all
        a, b, n_a, n_b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)], n_a * right, n_b * right
        group_a, group_b, at_a, at_b = align(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        of_a = np.repeat(np.arange(len(new)), n_a)
        n_groups = np.bincount(of_a[at_a], minlength=len(new))
        # tokens by group, the first side's before the second's
        group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, rank = np.concatenate([a, b])[order], (group * 2 + side)[order]
        last = np.append(rank[1:], -1) != rank
        named = ids + self.size * np.where(last, 1 + rank % 2, 0)
        whole = "".join(map(self.names.__getitem__, named.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.widths[named])])[np.cumsum(n_a + n_b)].tolist()
        begin = len(self.text)
        self.text += [whole[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        links = np.cumsum(n_groups) - n_groups + len(self.codes)
        self.facts = np.concatenate([self.facts, np.stack([right, n_a, n_b, n_groups, links], axis=1)])
        self.codes = np.concatenate([self.codes, a[at_a] << 32 | b[at_b]])
        self.number.update(zip(new, range(begin, begin + len(new)), strict=True))


    @staticmethod
    def _right(new: list[str], ids: np.ndarray, n: np.ndarray, names: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Whether the tokens of each cell give back its bytes."""
        want = [f" {c}".encode() for c in new]
        got = b"".join(map(names.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(n)])]
        if got == b"".join(want) and (np.diff(ends) == np.fromiter(map(len, want), np.int64, len(want))).all():
            return np.ones(len(new), bool)
        at = ends.tolist()
        return np.fromiter((got[i:j] == w for i, j, w in zip(at[:-1], at[1:], want, strict=True)), bool, len(new))


_known: dict[int, Known] = {}


def known(byte_level: str, pieces: bytes) -> Known:
    """The cells that the worker process has aligned."""
    key = hash((byte_level, pieces))
    if key not in _known:
        _known.clear()
        _known[key] = Known(Sides(byte_level, pieces))
    return _known[key]


def _described(have: Known, docs: list[str]) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups of each text, its groups' digest (None without tokens), its links' codes (flat) and their number."""
    if len(have.number) > CELLS:
        have.clear()
    lists = [cells(d) if d else [] for d in docs]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = have.look_up([c for x in lists for c in x])
    doc = np.repeat(np.arange(len(docs)), n)
    facts = have.facts[flat]
    wrong = np.bincount(doc[facts[:, 0] == 0], minlength=len(docs)) > 0
    good = ~wrong & (n > 0)
    facts[~good[doc], 1:4] = 0
    sums = np.stack([np.bincount(doc, facts[:, k], len(docs)).astype(np.int64) for k in (1, 2, 3)], axis=1)
    ends, numbers, text = np.cumsum(n), flat.tolist(), have.text
    digest = [hashlib.sha256("".join([text[i] for i in numbers[e - k : e]])[:-1].encode()).hexdigest() if g else None for e, k, g in zip(ends.tolist(), n.tolist(), good.tolist(), strict=True)]
    return sums, digest, have.codes[ragged(facts[:, 4], facts[:, 3])], sums[:, 2]


def _texts(byte_level, pieces, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, part, chunk = known(byte_level.value, pieces.value), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held, size
            if not held:
                return
            name = part << 32 | chunk
            pairs, at, times = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            at, begin = at.astype("<u4"), 0
            empty = pa.nulls
            for ids, sums, digest, codes, n in held:
                ends = begin + np.cumsum(n)
                links = [at[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                begin += len(codes)
                columns = [pa.array(np.full(len(n), name)), ids, *[pa.array(sums[:, k]) for k in range(3)], pa.array([d or "" for d in digest]), pa.array(links, pa.binary()), empty(len(n), pa.binary()), empty(len(n), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)
            # the chunk's own row: its distinct links and how often each occurs
            last = [pa.array([name]), *[empty(1, pa.int64())] * 4, empty(1, pa.string()), empty(1, pa.binary()), pa.array([pairs.astype("<i8").tobytes()], pa.binary()), pa.array([times.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, names=NAMES)
            chunk, held, size = chunk + 1, [], 0
            del pairs, at, times
            release()

        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(sizes, 1 << 20):
                docs = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                held.append((batch.column(0).slice(i, j - i), *_described(have, docs)))
                size += sum(sizes[i:j])
                if size >= chunk_bytes:
                    yield from flush()
        yield from flush()

    return run


NAMES = [c.split()[0] for c in TEXTS.split(", ")]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, times in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            codes = np.frombuffer(pairs, "<i8")
            columns = [np.full(len(codes), chunk), np.arange(len(codes)), codes >> 32, codes & 0xFFFFFFFF, np.frombuffer(times, "<i8")]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["chunk", "at", "a", "b", "times"])


def _finished(texts: pa.Table, looked: pa.Table) -> pa.Table:
    """The texts of a chunk with the sums over their links."""
    count, best = np.zeros(len(looked), np.int64), np.zeros(len(looked), np.int64)
    at = looked["at"].to_numpy()
    count[at], best[at] = looked["times"].to_numpy(), looked["best"].to_numpy()
    links = texts["links"].to_pylist()
    n = np.fromiter(map(len, links), np.int64, len(links)) // 4
    ends, own = np.cumsum(n), np.frombuffer(b"".join(links), "<u4")
    # running sums of integers are exact
    total, hits = (np.concatenate([[0], np.cumsum(x[own])]) for x in (count, best))
    sums = {"n_links": n, "n_best": hits[ends] - hits[ends - n], "count_sum": total[ends] - total[ends - n]}
    columns = {c: pa.array(sums[c]) if c in sums else texts[c] for c in (x.split()[0] for x in RESULT.split(", "))}
    return pa.table(columns)


def link_counts(pairs: DataFrame) -> DataFrame:
    """a, b, times, best of ``pairs`` (a, b, times): how often two ids are linked in all, and whether (1 or 0) that is the most of b's links."""
    counts = pairs.groupBy("a", "b").agg(F.sum("times").alias("times"))
    most = counts.groupBy("b").agg(F.max("times").alias("most"))
    return counts.join(most, "b").select("a", "b", "times", (F.col("times") == F.col("most")).cast("long").alias("best"))


def alignment(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs`` (doc_id, text).

    Side a is a byte-level BPE file of the ``tokenizers`` library over a space and the text, side b a ``sentencepiece`` model over the text, to which it adds the space; no special
    tokens. Groups are written ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and those whose tokens' bytes differ from the space and the text on either side,
    have no tokens: zeros and an empty digest, and they count nowhere. Texts are encoded whole; one without spaces is one cell, however long. Rows with a null doc_id and repeated rows
    are rows like any other and count. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        byte_level = spark.sparkContext.broadcast(f.read())
    with open(pieces or default_pieces(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    held = stash(only(docs, "doc_id", "text").mapInArrow(_texts(byte_level, model, chunk_bytes), TEXTS))
    pairs = stash(held.where("pairs is not null").select("chunk", "pairs", "times").mapInArrow(_pairs, "chunk long, at long, a long, b long, times long"))
    looked = pairs.drop("times").join(link_counts(pairs), ["a", "b"]).select("chunk", "at", "times", "best")
    texts = held.where("pairs is null").drop("pairs", "times")
    return texts.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(_finished, RESULT)
