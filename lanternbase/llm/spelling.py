"""Spelling variants: words one code point apart, grouped by wildcard patterns and never paired.

A word with one code point left out belongs to the group (position, prefix, suffix). Members of a group replace each other, so
the group's size and its two best words tell each member how many such neighbours it has and which is best. The groups whose prefix and suffix
join to a word of the vocabulary tell that word which longer words contain it, and their members which shorter word they contain. Prefix
and suffix travel as 124 bits of polynomial hashes, so a word of any length costs a row of 40 bytes for each code point, and rows number the
letters of the vocabulary, however many words are near each other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import binary_column, slices
from .common import only, stash

LEAST, OCCURRENCES, RATIO = 7, 2, 10
#: Distinct words that a task counts before it passes them on.
HELD = 250_000
LETTERS = "a-zÀ-ÿ"
MEMBERS = "high long, low long, pos int, rank long, opens boolean"

_lower = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
PRIME = (1 << 31) - 1
BASES = (1_000_003, 16_777_619, 433_494_437, 1_190_494_759)


def worn(word: str, before: int, wear: int) -> str:
    """``word`` less one code point, where ``wear`` divides its checksum, which goes on from that of the text ``before`` it."""
    h = zlib.crc32(word.encode(), before)
    if h % wear:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(least: int, wear: int | None):
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def emit(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), binary_column(batch.column(1)), strict=True):
                begin = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(runs.findall(raw.translate(_lower).decode())).items():
                    if wear and doc is not None:
                        word = worn(word, begin, wear)
                        if len(word) < least:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= HELD:
                    yield emit(total)
                    total = {}
        yield emit(total)

    return run


def vocabulary(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, wear: int | None = None) -> DataFrame:
    """word, n: runs of letters (A-Z lower-cased, no others) of all texts of ``docs`` (doc_id, text), of ``least`` code points and ``occurrences`` occurrences.

    ``wear`` leaves one code point out of the runs whose checksum with their doc_id it divides, as a controlled source of misspellings; rows
    without doc_id are read as they are.
    """
    counted = only(docs, "doc_id", "text").mapInArrow(_count(least, wear), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo PRIME."""
    out = np.ones(max(n, 1), np.int64)
    done = 1
    while done < n:
        some = min(done, n - done)
        out[done : done + some] = out[:some] * pow(base, done, PRIME) % PRIME
        done += some
    return out


def shortened(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (two longs) of all words less each of their code points, in order, and of the words themselves, as rows of two arrays.

    codes: the words' code points, one word after the other.
    """
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(codes)) - (ends - lengths)[word]
    less, whole = [], []
    for base in BASES:
        power = _powers(base, int(lengths.max(initial=0)))
        term = codes * power[pos] % PRIME
        upto = np.concatenate([[0], np.cumsum(term)])
        begin, total = upto[ends - lengths], upto[ends]
        before, after = upto[:-1] - begin[word], total[word] - upto[1:]
        less.append((before + after % PRIME * pow(base, -1, PRIME)) % PRIME)
        whole.append((total - begin) % PRIME)
    return tuple(np.stack([h[0] << 31 | h[1], h[2] << 31 | h[3]]) for h in (less, whole))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0)
        for i, j in slices([len(w) for w in words.to_pylist()], 1 << 18):
            some = words.slice(i, j - i).to_pylist()
            rank = batch.column(1).slice(i, j - i).to_numpy()
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.int64)
            less, whole = shortened(codes, lengths)
            word = np.repeat(np.arange(len(some)), lengths)
            pos = np.arange(len(codes)) - (np.cumsum(lengths) - lengths)[word]
            # of equal neighbouring code points, the first stands for all: leaving any out gives the same word
            opens = (pos == 0) | (codes != np.concatenate([[0], codes[:-1]]))
            high, low = np.concatenate([whole, less], axis=1)
            columns = [high, low, np.concatenate([np.full(len(some), -1), pos]).astype(np.int32), np.concatenate([rank, rank[word]]), np.concatenate([np.zeros(len(some), bool), opens])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["high", "low", "pos", "rank", "opens"])


def _near(words: DataFrame) -> DataFrame:
    """rank, n_near, best (the least rank of its near words) of each word of ``words`` (word, rank) that has a near word."""
    keys = ["high", "low"]
    members = words.select("word", "rank").mapInArrow(_members, MEMBERS)
    # one shuffle and one sort serve both kinds of groups: those of a pattern lie within those of its shortened word
    rows = members.repartition(*keys).sortWithinPartitions(*keys, "pos", "rank")
    shorter = Window.partitionBy(*keys)
    group = Window.partitionBy(*keys, "pos").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "rank",
        "opens",
        F.col("pos").alias("pos"),
        F.count("*").over(group).alias("size"),
        F.first("rank").over(group).alias("first"),
        F.nth_value("rank", 2).over(group).alias("second"),
        F.min(F.when(F.col("pos") < 0, F.col("rank"))).over(shorter).alias("own"),
        F.count(F.when(F.col("opens"), 1)).over(shorter).alias("longer"),
        F.min(F.when(F.col("opens"), F.col("rank"))).over(shorter).alias("longest"),
    )
    replaced = F.when(F.col("first") == F.col("rank"), F.col("second")).otherwise(F.col("first"))
    contained = F.when(F.col("opens"), F.col("own"))
    # the word itself: longer words that hold it
    whole = F.col("pos") < 0
    each = rows.select(
        "rank",
        F.when(whole, F.col("longer")).otherwise(F.col("size") - 1 + F.when(contained.isNotNull(), 1).otherwise(0)).alias("n_near"),
        F.when(whole, F.col("longest")).otherwise(F.least(replaced, contained)).alias("best"),
    )
    return each.where("n_near > 0").groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """rank, root: where the chain of each row of ``links`` (rank, root; no cycles) ends. Each round doubles the steps taken."""
    links = stash(links)
    while True:
        ahead = links.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        step = stash(links.join(ahead, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return links
        links = step.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row of ``words`` (word, n; words do not repeat).

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word of largest n (ties: the
    smallest in code-point order), if that n is ``ratio`` times its own or more; root follows forms to the last and is the word itself if
    it has none. Words of any length take part, the empty one and null do not. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could go in circles")
    ordered = only(words, "word", "n").where("word <> ''").repartitionByRange(F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word"))
    # ascending ids in the order of (n descending, word): the least of some ids is the best of their words
    ranked = stash(ordered.withColumn("rank", F.monotonically_increasing_id()))
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = ranked.join(_near(ranked), "rank", "left").join(best, "best", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    found = stash(found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(fits, F.col(c)).alias(c) for c in ("form", "form_n", "best")]))
    ends = roots(found.where("best is not null").select("rank", F.col("best").alias("root")))
    last = ends.join(ranked.select(F.col("rank").alias("root"), F.col("word").alias("last")), "root").select("rank", "last")
    return found.join(last, "rank", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("last", "word").alias("root"))


def spelling_variants(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, ratio: int = RATIO, wear: int | None = None) -> DataFrame:
    """``variants`` of the ``vocabulary`` of ``docs`` (doc_id, text).

    Null and empty texts have no words; texts are read whole, however long, and so are their longest words. Repeated rows count again; extra
    columns are ignored; an empty table gives an empty result.
    """
    return variants(vocabulary(docs, least, occurrences, wear), ratio)
