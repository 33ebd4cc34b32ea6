"""Markdown files to header-delimited chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternbase.functions.text import document_tokens, trim
from lanternbase.functions.words import SPACE, are_plain, count_plain

_HEADER = re.compile("^#{1,3} ", re.MULTILINE)
#: Characters of sections that a task passes on together.
TOGETHER = 4 << 20
_SECTIONS = "path string, begin int, end int, h1 string, h2 string, h3 string, text string, dl int"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_id(path: Column, start: Column, end: Column, text: Column) -> Column:
    return sha256(F.concat_ws(":", path, start.cast("string"), end.cast("string"), sha256(text)))


def embedding_input(context: Column, text: Column) -> Column:
    """The text, after its breadcrumb if it has one."""
    return F.when(context == "", text).otherwise(F.concat(context, F.lit("\n\n"), text))


def sections(content: str) -> Iterator[tuple]:
    """First and last line (from 1), the header lines of the three levels that hold for it, and text, trimmed, of each section."""
    starts = [m.start() for m in _HEADER.finditer(content)] if "# " in content else []
    bounds = [*([0] if not starts or starts[0] else []), *starts, len(content)]
    heads: list[str | None] = [None, None, None]
    line = 1
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        text = content[a:b]
        if found := _HEADER.match(text):
            level = found.end() - 1
            heads = [*heads[: level - 1], text.split("\n", 1)[0], *[None] * (3 - level)]
        n = text.count("\n") + (not text.endswith("\n"))
        yield line, line + n - 1, *heads, text.replace("\r\n", "\n").strip(SPACE)
        line += n


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]

    def passed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        # Spark counts the tokens of the other texts
        known = are_plain(columns[-1])
        some = columns[-1] if known.all() else pc.if_else(pa.array(known), columns[-1], "")
        counts = pa.array(count_plain(some).astype(np.int32), mask=~known)
        return pa.RecordBatch.from_arrays([*columns, counts], names=[c.split()[0] for c in _SECTIONS.split(", ")])

    rows, n = [], 0
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            for row in sections(content.as_py() or ""):
                rows.append((path.as_py(), *row))
                n += len(row[-1]) + 128
            if n >= TOGETHER:
                yield passed(rows)
                rows, n = [], 0
    if rows:
        yield passed(rows)


def chunks(files: DataFrame) -> DataFrame:
    """id, path, start_line, end_line, context, text of each section of ``files`` (path, content)."""
    return counted_chunks(files).drop("dl")


def counted_chunks(files: DataFrame) -> DataFrame:
    """id, path, start_line, end_line, context, text, dl (its number of tokens) of each section of ``files`` (path, content).

    A line of one to three # and a space begins a section, with its title in the breadcrumb; text before the first is a section of
    its own. Line numbers start at 1 and count a section's blank lines; its text is trimmed, and blank sections go. A file is cut where its row is:
    nothing is shuffled, and no row is made of a line.
    """
    rows = files.select("path", "content").mapInArrow(_cut, _SECTIONS)
    context = F.concat_ws(" > ", *[trim(F.regexp_replace(h, "^#+", "")) for h in ("h1", "h2", "h3")])
    kept = rows.where("text <> ''").select("path", F.col("begin").alias("start_line"), F.col("end").alias("end_line"), context.alias("context"), "text", "dl")
    dl = F.when(F.col("dl").isNull(), F.size(document_tokens(F.col("text")))).otherwise(F.col("dl"))
    return kept.select(chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("id"), "path", "start_line", "end_line", "context", "text", dl.alias("dl"))
