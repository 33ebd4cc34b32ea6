"""Suffix-array substring deduplication over bytes, by maximal repeat groups of an enhanced suffix array.

``maximal_repeats`` builds the suffix array and the common-prefix table of some texts, scans it with a stack for
its common-prefix intervals, and keeps those whose occurrences differ in the byte before them (or begin a text):
the maximal repeats, each with all its occurrences, not only neighbouring ones. The frame in ``repeats`` brings
together the stretches of a corpus that may hold a repeat; there, a repeat is removed from all documents
but the one with the smallest id.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import ragged, slices
from .common import only
from .repeats import HOT, NONE, PARTITION_BYTES, ByteUnits, repeated, text_key

LEAST = 50
#: Occurrences that are listed together, about.
MEMBERS = 1 << 18


@dataclass
class Repeats:
    """Maximal repeats: length of each; member k belongs to repeat ``group[k]`` and starts at ``start[k]`` of ``text[k]``."""

    length: np.ndarray
    group: np.ndarray
    text: np.ndarray
    start: np.ndarray


def _rank(key: np.ndarray) -> np.ndarray:
    """Of each key, how many are smaller."""
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(len(key), np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return rank


def _finer(rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Ranks by ``rank``, then ``after``; only ranks that several have need a look."""
    some = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
    out = rank.copy()
    if len(some):
        key = rank[some].astype(np.int64) << 32 | after[some]
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.concatenate([[True], k[1:] >> 32 != k[:-1] >> 32])
        place = np.arange(len(k))
        within = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        out[some[order]] = (k >> 32) + within
    return out


def maximal_repeats(texts: list[bytes], least: int = LEAST, together: int = MEMBERS, twice: np.ndarray | None = None) -> Iterator[Repeats]:
    """All maximal repeats of ``least`` or more bytes in and between the texts; none crosses a text's end.

    They come in parts of about ``together`` occurrences together, since repeats nest and an occurrence is in many; a
    repeat is never cut. A text marked in ``twice`` stands for two equal ones: text i occurs as i and as len(texts) + i, and a suffix that
    stands for two is an interval of its own.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(size.sum())
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    begin = np.cumsum(size) - size
    left_over = np.repeat((begin + size).astype(np.int32), size) - np.arange(total, dtype=np.int32)
    # symbols are bytes plus one; zero stands past the end of a text
    symbol = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + np.int16(1)
    some = np.flatnonzero(left_over >= least)
    twice = np.zeros(len(texts), bool) if twice is None else twice
    if not len(some):
        return

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by < total:
            out[: total - by] = np.where(left_over[: total - by] > by, x[by:], 0)
        return out

    key = np.zeros(total, np.int64)
    for j in range(7):
        key = key << 9 | shifted(symbol, j)
    ranks = {7: _rank(key)}
    del key
    level = 7
    while level < int(size.max()) and (np.bincount(ranks[level], minlength=total) > 1).any():
        ranks[2 * level] = _finer(ranks[level], shifted(ranks[level] + np.int32(1), level))
        level *= 2
    # suffixes with enough bytes left, in order
    suffixes = some[np.argsort(ranks[level][some], kind="stable")]
    # common prefixes of neighbours
    a, b = suffixes[:-1], suffixes[1:]
    most = np.minimum(left_over[a], left_over[b])
    lcp = np.zeros(len(a), np.int64)
    for level, times in [*((x, 1) for x in sorted(ranks, reverse=True)), (1, 6)]:
        table = ranks.get(level, symbol)
        live = np.arange(len(a))
        for _ in range(times):
            x, y = a[live] + lcp[live], b[live] + lcp[live]
            ok = (lcp[live] < most[live]) & (table[np.minimum(x, total - 1)] == table[np.minimum(y, total - 1)])
            live = live[ok]
            lcp[live] += level
    lcp = np.minimum(lcp, most)
    # bytes before: a change between neighbours, or a text's beginning, makes an interval diverse to the left
    before = np.where(suffixes > begin[owner[suffixes]], symbol[np.maximum(suffixes - 1, 0)], 0)
    alone = before == 0
    change = np.concatenate([[False], (before[1:] != before[:-1]) | alone[1:] | alone[:-1]])
    changes = np.cumsum(change)
    low, high, length = _intervals(lcp, least)
    diverse = changes[high] > changes[low]
    beside = np.maximum(np.concatenate([[0], lcp]), np.concatenate([lcp, [0]]))
    whole = np.flatnonzero(alone & twice[owner[suffixes]] & (left_over[suffixes] > beside))
    low, high, length = (np.concatenate(x) for x in ((low[diverse], whole), (high[diverse], whole), (length[diverse], left_over[suffixes[whole]])))
    del ranks, lcp, a, b, most
    n = high - low + 1
    for i, j in slices(n.tolist(), together):
        members, group = suffixes[ragged(low[i:j], n[i:j])], np.repeat(np.arange(j - i), n[i:j])
        text, start = owner[members], members - begin[owner[members]]
        also = twice[text]
        if also.any():
            group, text, start = (np.concatenate(x) for x in ((group, group[also]), (text, text[also] + np.int32(len(texts))), (start, start[also])))
        yield Repeats(length[i:j], group, text, start)


def _intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last entry and length of each common-prefix interval; lcp[i] stands between entries i and i + 1."""
    high_enough = lcp >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[False], high_enough, [False]])))
    begin, stop = edge[::2], edge[1::2]  # runs lcp[begin:stop], entries begin .. stop
    if not len(begin):
        return begin, begin, begin
    value = np.where(high_enough, lcp, 0)
    top = np.maximum.reduceat(value, begin)
    bottom = np.minimum.reduceat(np.append(np.where(high_enough, lcp, np.iinfo(np.int64).max), np.iinfo(np.int64).max), begin)
    even = top == bottom  # one interval each
    low, high, length = [begin[even]], [stop[even]], [top[even]]
    out_low, out_high, out_length = array("q"), array("q"), array("q")
    for s, e in zip(begin[~even].tolist(), stop[~even].tolist(), strict=True):
        stack = [(least - 1, s)]
        for i, depth in enumerate([*lcp[s:e].tolist(), least - 1], s):
            first = i
            while stack[-1][0] > depth:
                was, first = stack.pop()
                out_low.append(first)
                out_high.append(i)
                out_length.append(was)
            if stack[-1][0] < depth:
                stack.append((depth, first))
    return tuple(np.concatenate([*x, np.frombuffer(y, np.int64)]) for x, y in ((low, out_low), (high, out_high), (length, out_length)))


def solve(texts: list[bytes], group: np.ndarray, ids: np.ndarray, second: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of fragments that a repeat with a smaller document covers; see ``repeats.Solver``. Equal windows only occur in one group."""
    twice = second < NONE
    ids = np.concatenate([ids, second])
    size = np.tile(np.fromiter(map(len, texts), np.int64, len(texts)), 2)
    size[len(texts) :][~twice] = 0
    base = np.cumsum(size) - size
    reach = np.zeros(int(size.sum()), np.int64)
    for r in maximal_repeats(texts, least, twice=twice):
        smallest = np.full(len(r.length), np.iinfo(np.int64).max)
        np.minimum.at(smallest, r.group, ids[r.text])
        later = ids[r.text] > smallest[r.group]
        at = (base[r.text] + r.start)[later]
        np.maximum.at(reach, at, at + r.length[r.group][later])
    # runs of covered bytes, cut between texts
    covered = np.maximum.accumulate(reach) > np.arange(len(reach)) if len(reach) else reach > 0
    fresh = np.zeros(len(reach) + 1, bool)
    fresh[base[size > 0]] = True
    before = np.concatenate([[False], covered[:-1]]) & ~fresh[:-1]
    start = np.flatnonzero(covered & ~before)
    after = np.concatenate([covered[1:], [False]]) & ~fresh[1:]
    stop = np.flatnonzero(covered & ~after) + 1
    text = np.searchsorted(base + size, start, side="right")
    return text, start - base[text], stop - base[text]


def remove_repeats(docs: DataFrame, least: int = LEAST, digest: bool = False, hot: int = HOT, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, starts, ends (of the maximal removed runs) and kept of every row of ``docs`` (doc_id, text).

    Removed is each byte of the UTF-8 text covered by a string of ``least`` bytes that also starts in a document with a smaller
    doc_id; strings are judged on the input. A text of any length counts whole and is not
    split: a task holds the anchors of one at once. kept: the remaining bytes, or their SHA-256 if ``digest``. Null texts are empty.
    A row without a doc_id neither loses nor removes anything; repeated rows of one doc_id don't remove each other.
    Extra columns are ignored; an empty table gives an empty result.
    """
    if least < 20:
        raise ValueError("least must be 20 or more")
    units = ByteUnits(window=least)

    def solver(texts, group, ids, second):
        return solve(texts, group, ids, second, least)

    own = F.coalesce("text", F.lit("")).cast("binary")
    own = F.unhex(F.sha2(own, 256)) if digest else own
    rows = only(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.when(F.col("doc_id").isNull(), own).alias("own"))
    return settle(rows, repeated(docs, units, solver, "digest" if digest else "units", hot, partition_bytes), "n_bytes")


def settle(rows: DataFrame, texts: DataFrame, count: str) -> DataFrame:
    """Every row's result from that of its text: that of the smallest id, or of the later copies."""
    copy = F.col("doc_id") > F.col("least")
    free = F.array().cast("array<long>")
    joined = rows.join(texts, "key", "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("n")), F.col(count)).alias(count),
        F.when(F.col("doc_id").isNull(), F.lit(0)).when(copy, F.col("copy_removed")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(F.col("doc_id").isNull(), free).when(copy, F.col("copy_starts")).otherwise(F.col("starts")).alias("starts"),
        F.when(F.col("doc_id").isNull(), free).when(copy, F.col("copy_ends")).otherwise(F.col("ends")).alias("ends"),
        F.when(F.col("doc_id").isNull(), F.col("own")).when(copy, F.col("copy_kept")).otherwise(F.col("kept")).alias("kept"),
    )
