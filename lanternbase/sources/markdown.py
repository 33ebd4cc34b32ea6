"""Markdown files of a folder as rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternbase.sources import tree


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def n_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a folder and below."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system's name, as a URI."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


def _hidden(spark: SparkSession, folder: str) -> str | None:
    """Any *.md file that Spark's reader leaves out, as its name or a folder's on the way begins with ``_`` or ``.``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    root, found = fs.makeQualified(where).toUri().getPath().rstrip("/") + "/", fs.listFiles(where, True)
    while found.hasNext():
        name = found.next().getPath().toUri().getPath().removeprefix(root)
        if name.endswith(".md") and any(part[0] in "_." for part in name.split("/")):
            return name
    return None


def scan(spark: SparkSession, workspace: str, folder: str = "memory") -> DataFrame:
    """path (below ``workspace``), content, mtime (epoch seconds), size of every *.md file in ``folder`` and below.

    Names that begin with ``_`` or ``.`` count like any other. Tasks list and read the files; of stores that Arrow can't open, Spark's own reader reads them, and a name that it would leave out is
    an error. So is, when it is read, a file that is not UTF-8.
    """
    where = qualified(spark, f"{workspace}/{folder}")
    try:
        _, top = tree.opened(where)
        rows = tree.files(spark, where)
    except pa.ArrowInvalid:
        if name := _hidden(spark, where):
            raise ValueError(f"this store's files are read by Spark, which leaves out names like {name}") from None
        top = spark._jvm.org.apache.hadoop.fs.Path(where).toUri().getPath().rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(where)
        # paths come with the file system's name
        plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
        rows = files.select(plain.alias("path"), "content", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"))
    # what stands before the workspace is cut
    path = F.substring("path", len(top) - len(folder.strip("/")) + 1, 1 << 20)
    text = F.decode("content", "UTF-8")
    whole = F.when(F.is_valid_utf8(F.col("content").cast("string")), text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), path)).cast("string"))
    return rows.select(path.alias("path"), whole.alias("content"), "mtime", "size")


def read_optional(spark: SparkSession, path: str) -> str | None:
    """A small text file's content, None if it can't be read."""
    if not exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).head(1)
    return rows[0][0] if rows else None
