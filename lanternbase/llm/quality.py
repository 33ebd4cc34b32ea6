"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text by numpy and string primitives in Arrow batches. The trees are fitted on the driver on
a bounded sample of labelled rows (``SAMPLE``), and flattened into arrays that score a batch by vectorised
traversal: all rows go down all trees together, one level at a time.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import binary_column
from .common import numbered, only

#: Labelled documents that the fit uses at most: those of the least hashes of their ids.
SAMPLE = 16_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 5, 64, 0.15, 1.0, 8.0
MARKS = b"|!%$#*&.,;:?@/\\-_+=<>(){}[]\"'~^`"
STATISTICS = (
    ["log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_next_word", "top_word", "upper", "title_words", "digits", "spaces", "newlines", "not_ascii", "control", "entropy", "distinct_lines", "line_bytes", "longest_word", "marked_word_ends", "all_marks"]
    + [f"mark_{m:02x}" for m in MARKS]
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """(n, len(STATISTICS)) numbers, all finite; an empty text gives zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    marks = np.frombuffer(MARKS, np.uint8)
    for i, text in enumerate(texts):
        if not text:
            continue
        n = len(text)
        hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        k = len(words) or 1
        lines = text.split(b"\n")
        part = hist[hist > 0] / n
        upper, lower = hist[65:91].sum(), hist[97:123].sum()
        counted = Counter(words)
        out[i, :19] = (
            np.log1p(n),
            np.log1p(len(words)),
            (n - hist[32] - hist[9:14].sum()) / k,
            len(counted) / k,
            sum(map(operator.eq, words, words[1:])) / k,
            max(counted.values(), default=0) / k,
            upper / max(1, upper + lower),
            sum(w[:1].isupper() and not w.isupper() for w in words) / k,
            hist[48:58].sum() / n,
            hist[32] / n,
            hist[10] / n,
            hist[128:].sum() / n,
            (hist[:9].sum() + hist[14:32].sum() + hist[127]) / n,
            -(part * np.log2(part)).sum(),
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)),
            np.log1p(max(map(len, words), default=0)),
            sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / k,
            hist[marks].sum() / n,
        )
        out[i, 19:] = hist[marks] / k
    return out


@dataclass
class Trees:
    """Flattened trees: per tree and node a statistic, a threshold, the left child (the right one follows it) and a value."""

    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        tree = np.arange(len(self.left))
        total = np.full(len(x), self.bias)
        for a in range(0, len(x), 4096):
            rows = np.arange(min(4096, len(x) - a))[:, None]
            part = x[a : a + 4096]
            node = np.zeros((len(part), len(tree)), np.int64)
            for _ in range(self.depth):
                left = self.left[tree, node]
                go = left + (part[rows, self.statistic[tree, node]] > self.threshold[tree, node])
                node = np.where(left > 0, go, node)
            total[a : a + 4096] += self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Second-order boosting on the logistic loss, splits from histograms of quantile bins. Deterministic.

    Without both labels the result is a constant: 0.5 without any, else (ones + 1) / (rows + 2).
    """
    n, k = x.shape if len(x) else (0, len(STATISTICS))
    ones = float(y.sum()) if n else 0.0
    rate_of_ones = (ones + 1) / (n + 2)
    size = 2 ** (depth + 1) - 1
    stat, cut = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    left, value = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    model = Trees(stat, cut, left, value, float(np.log(rate_of_ones / (1 - rate_of_ones))), depth)
    if not 0 < ones < n:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)])
    margin = np.full(n, model.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node, open_nodes, used = np.zeros(n, np.int64), [0], 1
        for level in range(depth + 1):
            slot = np.full(size, -1)
            slot[open_nodes] = np.arange(len(open_nodes))
            mine = slot[node]
            inside = np.flatnonzero(mine >= 0)
            m = len(open_nodes)
            g_all = np.bincount(mine[inside], grad[inside], m)
            h_all = np.bincount(mine[inside], hess[inside], m)
            value[t, open_nodes] = -rate * g_all / (h_all + L2)
            if level == depth:
                break
            best = np.full(m, 1e-6)
            which = np.full((m, 2), -1)
            for j in range(k):
                code = mine[inside] * bins + binned[j, inside]
                g = np.bincount(code, grad[inside], m * bins).reshape(m, bins).cumsum(axis=1)
                h = np.bincount(code, hess[inside], m * bins).reshape(m, bins).cumsum(axis=1)
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + L2) + gr**2 / (hr + L2) - (g_all**2 / (h_all + L2))[:, None]
                gain[(h < LEAST / 4) | (hr < LEAST / 4)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(m), top] > best
                best[better] = gain[np.arange(m), top][better]
                which[better] = np.stack([np.full(m, j), top], axis=1)[better]
            nxt = []
            for s, parent in enumerate(open_nodes):
                if which[s, 0] < 0:
                    continue
                j, b = which[s]
                stat[t, parent], cut[t, parent], left[t, parent] = j, edges[j][b], used
                here = inside[mine[inside] == s]
                node[here] = used + (binned[j, here] > b)
                nxt += [used, used + 1]
                used += 2
            open_nodes = nxt
            if not nxt:
                break
        margin += value[t, node]
    return model


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(binary_column(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits ``labels`` (doc_id, quality) on ``docs`` (doc_id, text).

    Rows with a null id or label are left out; of repeated labels of a document the mean counts (0.5 or more: 1), and of repeated documents the least text. At most
    ``sample`` labelled documents are used, chosen by the hash of their ids; that bounds what the driver gathers and what
    is broadcast (16 bytes each). Statistics read whole texts of any length. Empty documents or labels give a model that scores every text 0.5.
    """
    known = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    one = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = only(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = joined.mapInArrow(_stats_of, "doc_id long, x array<double>, y double").orderBy("doc_id").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x, y = np.stack(rows["x"].to_numpy()), (rows["y"].to_numpy() >= 0.5).astype(float)
    order = np.lexsort([*x.T, y, rows["doc_id"].to_numpy()])
    return fit(x[order], y[order])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch.column(batch.schema.get_field_index("text")))
            p = np.concatenate([model.value.score(statistics(texts[i : i + 1024])) for i in range(0, len(texts), 1024)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score (0 to 1) of every row of ``docs`` (doc_id, text).

    Null and empty texts get the score of all-zero statistics; long ones are read whole. Null ids and repeated rows are kept; extra columns are
    ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return only(docs, "doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")


def _keep(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch.column(at))
            good = [model.value.score(statistics(texts[i : i + 1024])) >= 0.5 for i in range(0, len(texts), 1024)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return run


def accepted(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns, also ones whose names differ in case only.

    Null, empty and long texts are judged as in ``score``; repeated rows share their fate; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flat, (text,) = numbered(docs, "text")
    return flat.mapInArrow(_keep(shared, flat.columns.index(text)), flat.schema).toDF(*docs.columns)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1: rows that never teach. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def teaching(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id")))
