"""Connected components of links between 64-bit nodes, without ever holding an unbounded graph in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Links that one task contracts at most (16 bytes each); beyond it the star rounds run distributed.
LOCAL_LINKS = 1_000_000
LINK = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node but the least ones themselves."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        live = x != y
        if not live.any():
            break
        u, v = u[live], v[live]
        np.minimum.at(root, np.maximum(x[live], y[live]), np.minimum(x[live], y[live]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition, replaced by a forest of as many links as it has nodes at most."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        a, b = forest(a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(a, b): every node of ``links`` (a, b) but the least of each component, with that least node.

    Links may repeat or join a node to itself. While there are more than ``local_links``, rounds of the
    large-star and small-star operations run (linear work each, a logarithmic number of rounds in practice);
    each is written to the shared folder. Fewer links are contracted in one task, which that number bounds.
    """
    e = stash(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    n, before = e.count(), None
    while n > local_links:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stash(large.where("a <> b").distinct())
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = stash(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        n = now[0]
        if now == before:
            return e
        before = now
    return e.repartition(1).mapInArrow(contract, LINK)
