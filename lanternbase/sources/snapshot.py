"""Tables as numbered snapshots: a new version is written beside the old ones and counts once its mark is there.

The mark is the last file that is written and no file is ever moved or overwritten, so a crash at any time leaves the last complete version
current, and nothing changes that a plan may be reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanternbase.sources.markdown import exists

MARK = "_COMPLETE"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, root: str) -> list[str]:
    fs, where = _fs(spark, root)
    if not fs.exists(where):
        return []
    return sorted(name for name in (s.getPath().getName() for s in fs.listStatus(where)) if name.startswith("v"))


def current(spark: SparkSession, root: str) -> str | None:
    """The highest complete version."""
    return next((v for v in reversed(_versions(spark, root)) if exists(spark, f"{root}/{v}/{MARK}")), None)


def read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """A table of the current version; empty if there is none."""
    version = current(spark, root)
    if version is None or not exists(spark, f"{root}/{version}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{version}/{table}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """Writes all tables as one new version and makes it current, unless ``check`` of the written tables raises."""
    known = _versions(spark, root)
    version = f"v{int(known[-1][1:].split('-')[0]) + 1 if known else 1:06d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    if check:
        check({name: spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}") for name, df in tables.items()})
    fs, mark = _fs(spark, f"{root}/{version}/{MARK}")
    fs.create(mark, False).close()
    return version
