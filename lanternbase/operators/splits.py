"""Sections of Markdown files that may be larger than a task: each split is cut by itself, and what it needs from those before it is one row a split.

A task turns the lines of a split into pieces of sections, with the headers that stand above them in the split. For files of several splits, running sums of lines give line numbers, and the last
headers of the splits before complete the breadcrumbs; only the pieces at the ends of splits are grouped again. Lines are never shuffled, and no row is made of one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternbase.functions.text import trim
from lanternbase.operators.chunk import chunk_id
from lanternbase.sources import tree
from lanternbase.sources.markdown import qualified
from lanternbase.sources.shared import keep

PIECES = "path string, block long, whole boolean, opens boolean, closes boolean, begin long, end long, h1 struct<line: string, pos: long>, h2 struct<line: string, pos: long>, h3 struct<line: string, pos: long>, text string"
_FIELDS = pa.struct([("line", pa.string()), ("pos", pa.int64())])
_KINDS = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), _FIELDS, _FIELDS, _FIELDS, pa.string()]
_HEADER = re.compile("#{1,3} ")
#: Bytes that a task reads from a file at a time, and characters of pieces that it passes on together.
READ, TOGETHER = 1 << 20, 4 << 20


class _Split:
    """The pieces of one split, as its lines come in."""

    def __init__(self, path: str, block: int, whole: bool):
        self.key, self.lines, self.heads = (path, block, whole), 0, [None, None, None]
        self.held: list[str] = []
        self.begin, self.opens = 0, True

    def piece(self, closes: bool) -> tuple:
        row = (*self.key, self.opens, closes, self.begin, self.lines - 1, *self.heads, "\n".join(self.held))
        self.held, self.opens, self.begin = [], False, self.lines
        return row

    def add(self, lines: list[str], headers: list[int]) -> Iterator[tuple]:
        """headers: places of header lines among these lines."""
        at = 0
        for place in [*headers, len(lines)]:
            self.held += lines[at:place]
            self.lines += place - at
            at = place
            if place < len(lines):
                if self.lines > self.begin:
                    yield self.piece(False)
                self.opens = False
                level = len(lines[place]) - len(lines[place].lstrip("#"))
                self.heads = [*self.heads]
                self.heads[level - 1] = {"line": lines[place], "pos": self.lines}
                self.held.append(lines[place])
                self.lines += 1
                at = place + 1


def _lines(file, begin: int, end: int) -> Iterator[list[str]]:
    """Lines of an open file whose first byte is in [begin, end), some at a time. Bytes that are not UTF-8 are replaced."""
    # from the byte before on, what stands up to a line's end belongs to the split before
    at, held, skip = max(begin - 1, 0), [], begin > 0
    file.seek(at)
    while at < end:
        data = file.read(READ)
        last = data.rfind(b"\n") + 1
        if data and not last:
            held.append(data)
            continue
        block, held = b"".join([*held, data[:last]]), [data[last:]]
        if not data and not block:
            return
        first = block.find(b"\n") + 1 if skip else 0
        # an end in this block: lines that begin there or later are not taken
        stop = block.find(b"\n", end - at - 1) + 1 or len(block)
        at += len(block)
        if skip and not first:
            return
        skip = False
        if stop > first:
            lines = block[first:stop].decode("utf-8", "replace").split("\n")
            if lines[-1] == "":
                lines.pop()
            yield [x[:-1] if x.endswith("\r") else x for x in lines]
        if not data:
            return


def _pieces(uri: str):
    """The pieces of splits (path, block, size of the file, bytes of a split)."""

    def passed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=["path", "block", "whole", "opens", "closes", "begin", "end", "h1", "h2", "h3", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = tree.opened(uri)
        rows, n = [], 0
        for batch in batches:
            for path, block, size, per in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                split = _Split(path, block, size <= per)
                with store.open_input_file(path) as file:
                    for lines in _lines(file, block, min(block + per, size)):
                        for row in split.add(lines, [i for i, x in enumerate(lines) if x[:1] == "#" and _HEADER.match(x)]):
                            rows.append(row)
                            n += len(row[-1]) + 256
                if split.lines:
                    rows.append(split.piece(True))
                    n += len(rows[-1][-1]) + 256
                if n > TOGETHER:
                    yield passed(rows)
                    rows, n = [], 0
        if rows:
            yield passed(rows)

    return run


def _breadcrumb(heads: list[Column]) -> Column:
    title = [trim(F.regexp_replace(h["line"], "^#+", "")) for h in heads]
    at = [F.coalesce(h["pos"], F.lit(-1)) for h in heads]
    return F.concat_ws(" > ", title[0], F.when(at[1] > at[0], title[1]), F.when((at[2] > at[0]) & (at[2] > at[1]), title[2]))


def file_chunks(spark: SparkSession, workspace: str, folder: str = "memory") -> DataFrame:
    """The rows of ``chunk.chunks`` for the *.md files in ``folder`` and below, read as lines: id, path (below ``workspace``), start_line, end_line, context, text.

    Files of any size are read by as many tasks as they have splits; a section is a row, however long. Names that begin with ``_`` or ``.`` are left out, as Spark's reader leaves them out, and
    bytes that are not UTF-8 are replaced; ``scan`` has both rules.
    """
    uri = qualified(spark, f"{workspace}/{folder}")
    _, top = tree.opened(uri)
    below = F.substring("path", len(top) + 2, 1 << 20)
    shown = ~F.exists(F.split(below, "/"), lambda x: x.startswith(".") | (x.startswith("_") & ~x.contains("=")))
    per = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    found = tree.names(spark, uri).where(shown & (F.col("size") > 0))
    splits = found.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(per).cast("long"))).alias("block"), "size", F.lit(per).cast("long").alias("per"))
    pieces = splits.repartition(4 * spark.sparkContext.defaultParallelism, "path", "block").mapInArrow(_pieces(uri), PIECES)
    # cut once: what follows takes the pieces several times
    pieces = keep(pieces.withColumn("path", F.substring("path", len(top) - len(folder.strip("/")) + 1, 1 << 20)))
    heads = ["h1", "h2", "h3"]
    plain = pieces.where("whole").select("path", "begin", "end", "text", *heads)
    parts = pieces.where("not whole")

    # one row a split: its lines, its last headers, and where its last section begins
    above = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = parts.where("closes").select("path", "block", (F.col("end") + 1).alias("n"), *heads, F.when(~F.col("opens"), F.col("begin")).alias("last"))
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(above), F.lit(0)))

    def moved(head: str, offset: str) -> Column:
        return F.when(F.col(head).isNotNull(), F.struct(F.col(f"{head}.line").alias("line"), (F.col(f"{head}.pos") + F.col(offset)).alias("pos")))

    carried = splits.select("path", "block", "offset", *[F.last(moved(h, "offset"), ignorenulls=True).over(above).alias(f"above_{h}") for h in heads], F.coalesce(F.last(F.col("last") + F.col("offset"), ignorenulls=True).over(above), F.lit(0)).alias("section"))
    both = parts.join(carried, ["path", "block"])
    both = both.select(
        "path",
        (F.col("begin") + F.col("offset")).alias("begin"),
        (F.col("end") + F.col("offset")).alias("end"),
        "text",
        *[F.coalesce(moved(h, "offset"), F.col(f"above_{h}")).alias(h) for h in heads],
        F.when(F.col("opens"), F.col("section")).otherwise(F.col("begin") + F.col("offset")).alias("section"),
        (F.col("opens") | F.col("closes")).alias("border"),
    )
    inner = both.where("not border").select(plain.columns)
    ends = both.where("border").groupBy("path", "section")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda x: x["text"]), "\n")
    border = ends.agg(F.min("begin").alias("begin"), F.max("end").alias("end"), joined.alias("text"), *[F.min_by(h, "begin").alias(h) for h in heads]).select(plain.columns)
    rows = plain.unionByName(inner).unionByName(border)
    rows = rows.select("path", (F.col("begin") + 1).cast("int").alias("start_line"), (F.col("end") + 1).cast("int").alias("end_line"), _breadcrumb([F.col(h) for h in heads]).alias("context"), trim(F.col("text")).alias("text")).where("text <> ''")
    return rows.select(chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("id"), "path", "start_line", "end_line", "context", "text")
