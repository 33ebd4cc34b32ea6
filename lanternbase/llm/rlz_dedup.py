"""Substring deduplication over words by relative Lempel-Ziv parsing.

Reference blocks are the blocks of the frame in ``repeats``: the stretches of all documents whose windows hold the block's
anchors. A block's index leads from each window of words to the place of the smallest document that
has it. Each stretch is then parsed greedily against the index of its block: at a position that starts a factor of a smaller
document, the factor runs on as long as text and reference agree. A greedy factor can end inside
another match, so the windows that begin within its last words are looked up, too, before parsing goes on
behind it. Factors of a window or more are the duplicate spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, Words, mix
from .common import numbered, only
from .repeats import HOT, NONE, PARTITION_BYTES, WordUnits, repeated, text_key, word_hashes
from .suffix_dedup import settle

WINDOW = 50
#: A base for rolling hashes of word hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass
class Factors:
    """Factor k: ``length[k]`` words from word ``start[k]`` of text ``text[k]``, equal to those from ``ref_start[k]`` of ``ref_text[k]``."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    ref_text: np.ndarray
    ref_start: np.ndarray


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` consecutive word hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, U), np.full(len(words) - 1, BASE, U)]), dtype=U)
        back = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, INVERSE, U)]), dtype=U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(words * power, dtype=U)])
        return mix((sums[window : window + n] - sums[:n]) * back)


def parse(texts: list[bytes], group: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> Factors:
    """Factors of ``window`` or more words of each text, relative to the texts of its group with smaller ids."""
    w = Words(texts)
    text = np.searchsorted(w.first, np.arange(len(w.start)), side="right") - 1
    h = window_hashes(word_hashes(w), window)
    whole = np.flatnonzero(np.arange(len(h)) + window <= w.first[text[: len(h)] + 1]) if len(h) else np.zeros(0, np.int64)
    t = text[whole]
    with np.errstate(over="ignore"):
        h = mix(h[whole] + group[t].astype(U) * U(0xC2B2AE3D27D4EB4F))
    # the index: of each window, the place in the smallest document
    order = np.lexsort((whole, ids[t], h))
    first = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(order) else np.zeros(0, bool)
    source = np.full(len(w.start) + 1, -1)
    source[whole[order]] = whole[order][first][np.cumsum(first) - 1] if len(order) else order
    found = np.full(len(w.start) + 1, False)
    found[whole] = ids[text[source[whole]]] < ids[t]
    # match[i]: words from i on that agree with the reference place of window i
    same = found[:-1] & found[1:] & (source[1:] == source[:-1] + 1)
    stop = np.where(same, len(same), np.arange(len(same)))
    run_end = np.minimum.accumulate(stop[::-1])[::-1] if len(stop) else stop
    match = np.where(found[:-1], run_end - np.arange(len(same)) + window, 0)
    hits = np.flatnonzero(found[:-1])
    out = []
    nxt = np.searchsorted(hits, np.arange(len(found) + 1)).tolist()
    hit_list, match_list = hits.tolist(), match.tolist()
    for t in np.unique(text[hits]).tolist():
        i, end = int(w.first[t]), int(w.first[t + 1])
        while nxt[i] < len(hit_list) and hit_list[nxt[i]] < end:
            i = hit_list[nxt[i]]
            out.append(i)
            # windows that begin in the factor's last words may be found elsewhere
            done = i + match_list[i]
            i = max(i + 1, done - window + 1)
    at = np.array(out, np.int64)
    return Factors(text[at], at - w.first[text[at]], match[at], text[source[at]], source[at] - w.first[text[source[at]]])


def solve(texts: list[bytes], group: np.ndarray, ids: np.ndarray, second: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The factors as stretches; see ``repeats.Solver``. A second occurrence is parsed as a text of its own."""
    also = np.flatnonzero(second < NONE)
    f = parse([*texts, *(texts[i] for i in also)], np.concatenate([group, group[also]]), np.concatenate([ids, second[also]]), window)
    return np.concatenate([np.arange(len(texts)), len(texts) + also])[f.text], f.start, f.start + f.length


def remove_spans(docs: DataFrame, window: int = WINDOW, digest: bool = False, hot: int = HOT, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, starts, ends (word positions of the maximal removed runs) and kept of every row of ``docs`` (doc_id, text).

    Words are the runs of characters other than space and U+0009 to U+000D. Removed is each word covered by a window of ``window``
    words that also starts in a document with a smaller doc_id; windows are judged on the input. A text of any length counts
    whole and is not split: a task holds the anchors of one at once. kept: the remaining words joined by one
    space, or their SHA-256 if ``digest``. Null texts have no words. A row without a doc_id neither loses nor
    removes anything; repeated rows of one doc_id don't remove each other. Extra columns are ignored; an
    empty table gives an empty result.
    """
    if window < 12:
        raise ValueError("window must be 12 or more")

    def solver(texts, group, ids, second):
        return solve(texts, group, ids, second, window)

    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+"), lambda x: x != "")
    own = F.array_join(words, " ").cast("binary")
    own = F.unhex(F.sha2(own, 256)) if digest else own
    lost = F.col("doc_id").isNull()
    rows = only(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("key"), F.when(lost, F.size(words)).cast("long").alias("n_words"), F.when(lost, own).alias("own"))
    return settle(rows, repeated(docs, WordUnits(window=window), solver, "digest" if digest else "units", hot, partition_bytes), "n_words")


def cut_spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rows of ``docs`` with all their columns, texts less the duplicate spans that ``remove_spans`` finds.

    A text that loses words is replaced by its other words joined by one space, and n_chars, where there is such a column, by the
    new length; all other texts, null ones too, and rows without a doc_id stay as they are. Long texts are read whole, as there; an empty table stays empty.
    """

    def solver(texts, group, ids, second):
        return solve(texts, group, ids, second, window)

    found = repeated(docs, WordUnits(window=window), solver, "text", hot, partition_bytes)
    found = found.select(*[F.col(c).alias(f"_span_{c}") for c in ("key", "least", "n_removed", "kept", "copy_removed", "copy_kept")])
    flat, (doc_id, own) = numbered(docs, "doc_id", "text")
    lost = F.col(doc_id).isNull()
    rows = flat.withColumns({"_span_of": text_key(F.col(own)), "_span_null": F.col(own).isNull()}).withColumn(own, F.when(lost, F.col(own)))
    copy = F.col(doc_id) > F.col("_span_least")
    kept = F.when(copy, F.col("_span_copy_kept")).otherwise(F.col("_span_kept"))
    n_removed = F.when(copy, F.col("_span_copy_removed")).otherwise(F.col("_span_n_removed"))
    joined = rows.join(found, F.col("_span_of") == F.col("_span_key"), "left")
    text = F.when(lost, F.col(own)).when(F.col("_span_null"), F.lit(None)).otherwise(kept.cast("string"))
    new: dict[str, F.Column] = {own: text}
    if "n_chars" in docs.columns:
        changed = ~lost & ~F.col("_span_null") & (n_removed > 0)
        _, (n_chars,) = numbered(docs, "n_chars")
        new[n_chars] = F.when(changed, F.length(text)).otherwise(F.col(n_chars)).cast(flat.schema[n_chars].dataType)
    return joined.withColumns(new).select(*flat.columns).toDF(*docs.columns)
