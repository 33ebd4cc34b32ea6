"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (local tests, one machine) a temporary folder is made and set as checkpoint folder. Other masters
    need the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lanternbase-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession, n_bytes: int = 0, per: int = 24 << 20) -> int:
    """Partitions to deal ``n_bytes`` over, ``per`` bytes each, at least the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, found by exact name first and by Spark's rules otherwise.

    Extra columns, also ones whose names differ in case only, never reach an operator.
    """
    flat, picked = numbered(df, *columns)
    return flat.select(*[F.col(i).alias(c) for i, c in zip(picked, columns, strict=True)])


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by their places, and the new names of these columns, found as in ``only``.

    What keeps all columns works on that, as no extra column's name can clash there, and gives the names back with ``toDF``.
    """
    picked = []
    for c in columns:
        at = [i for i, x in enumerate(df.columns) if x == c] or [i for i, x in enumerate(df.columns) if x.lower() == c.lower()]
        if not at:
            raise ValueError(f"column {c!r} is missing; there are {df.columns}")
        picked.append(f"_{at[0]}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), picked
