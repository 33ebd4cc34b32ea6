"""Packing by concatenate and cut: documents are laid end to end and cut into windows of fixed length.

Two passes. The first encodes each text once and writes the ids with each document's token offset within
its partition. The second adds the prefix sums of the partitions' token totals (one number per
partition) for global offsets, and cuts at the window bounds. Every sequence but the last is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import ragged, slices
from .common import only, stash
from .tokens import default_path, encoder

LENGTH, END_ID = 2048, 1
TOKENS = "doc_id long, part int, at long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(spec, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = encoder(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
            for i, j in slices(sizes, 4 << 20):
                flat, n = coder.ids(text.slice(i, j - i))
                raw = flat.astype("<u4" if coder.wide else "<u2")
                ends = np.cumsum(n)
                tail = np.array([end_id], raw.dtype).tobytes()
                ids = [raw[e - k : e].tobytes() + tail for e, k in zip(ends, n, strict=True)]
                n = n + 1
                offsets = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(offsets), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "at", "n", "ids"],
                )

    return run


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, at (token offset within the part), n, ids (little-endian, 2 or 4 bytes each) of every row, written once."""
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    return stash(only(docs, "doc_id", "text").mapInArrow(_encode(spec, end_id), TOKENS))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, n = (batch.column(k).to_numpy() for k in (1, 2))
            blobs = batch.column(3).to_pylist()
            pieces = (begin + n - 1) // length - begin // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            window = ragged(begin // length, pieces)
            lower = np.maximum(window * length, begin[doc])
            upper = np.minimum((window + 1) * length, (begin + n)[doc])
            start, size = lower - begin[doc], upper - lower
            crc = np.zeros(len(doc), np.int64)
            k = 0
            for blob, count, tokens in zip(blobs, pieces, n, strict=True):
                ids = memoryview(np.frombuffer(blob, f"<u{len(blob) // tokens}").astype("<u4").tobytes())
                for _ in range(count):
                    crc[k] = zlib.crc32(ids[4 * start[k] : 4 * (start[k] + size[k])])
                    k += 1
            names = PIECES.replace(" long", "").split(", ")
            columns = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, size, crc, n[doc], window, lower % length))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document (doc_id, text) in a sequence of ``length`` tokens.

    A document is its ids and ``end_id``; a null or empty text has the latter alone. Each token is in exactly one piece;
    sequences are numbered from 0 and filled without gaps, all but the last to their full length. A null doc_id is
    kept; repeated rows are packed as often as they occur. A text longer than a sequence is cut into as many pieces as it needs. Extra columns are ignored; an empty table gives no
    rows. The order of documents is that of the input's partitions.
    """
    if length < 1:
        raise ValueError("length must be positive")
    tokens = tokenize(docs, tokenizer, end_id)
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    # one row for each partition of the input, so this window and the broadcast hold as many rows as there were tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = totals.select("part", (F.sum("total").over(before) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("begin"), "n", "ids")
    return placed.mapInArrow(_cut(length), PIECES)
