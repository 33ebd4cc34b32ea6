"""Keeping an index in step with a snapshot of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternbase.operators.chunk import chunks, embedding_input, sha256


def catalog(files: DataFrame) -> DataFrame:
    """path, hash, mtime, size of ``files`` (path, content, mtime, size)."""
    return files.select("path", sha256(F.col("content")).alias("hash"), "mtime", "size")


def diff(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """path, status of each path in ``stored`` or ``disk`` (path, hash): indexed (new or changed), skipped (unchanged) or deleted."""
    both = stored.select("path", F.col("hash").alias("old")).join(disk.select("path", F.col("hash").alias("new")), "path", "full_outer")
    status = F.when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "skipped").otherwise("indexed")
    return both.select("path", status.alias("status"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: indexed, skipped, deleted."""
    return changes.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("indexed", "skipped", "deleted")])


def prune(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows of ``stored`` whose path is still on disk."""
    return stored.join(disk.select("path"), "path", "left_semi")


def stale(stored: DataFrame, disk: DataFrame) -> DataFrame:
    return stored.select("path").join(disk.select("path"), "path", "left_anti")


def rebuild(stored: DataFrame, files: DataFrame, changes: DataFrame, model: str, embed: Column | None) -> DataFrame:
    """Chunks of the new snapshot: those of skipped files as they are, those of indexed files made anew.

    ``embed`` is a column over ``input`` (an embedding, null where it failed); None leaves embeddings null.
    """
    kept = stored.join(changes.where("status = 'skipped'").select("path"), "path", "left_semi")
    changed = files.join(changes.where("status = 'indexed'").select("path"), "path", "left_semi")
    made = chunks(changed.select("path", "content")).withColumn("input", embedding_input(F.col("context"), F.col("text")))
    vector = F.lit(None).cast("array<float>") if embed is None else embed.cast("array<float>")
    made = made.select("id", "path", "start_line", "end_line", F.lit(model).alias("model"), "text", vector.alias("embedding"))
    return kept.select(made.columns).unionByName(made)


def check_widths(chunks_: DataFrame) -> None:
    """Raises if embeddings differ in width."""
    seen = [r[0] for r in chunks_.where("embedding is not null").select(F.size("embedding")).distinct().limit(2).collect()]
    if len(seen) > 1:
        raise ValueError(f"embeddings of different widths: {sorted(seen)}")
