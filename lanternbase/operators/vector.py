"""Exact nearest neighbours by Euclidean distance for a batch of query vectors.

Query vectors go to the tasks as matrices of ``BROADCAST_QUERIES`` at most, in one pass over the vectors for each; each Arrow batch keeps its own best k, so
the shuffle has k rows for each query and batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lanternbase.functions.scores import distance_to_similarity

BROADCAST_QUERIES = 10_000
#: Spread of similarities from which they are stretched to 0 .. 1 (fixed value).
SPREAD = 1e-6


def chosen(row: np.ndarray, col: np.ndarray, far: np.ndarray, names: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, candidate, distance) the ``k`` nearest of each query, ties to the smaller name: no more leave a batch, however many are equally near."""
    rank = np.argsort(pc.sort_indices(names).to_numpy())
    order = np.lexsort((rank[col], far, row))
    row, col, far = row[order], col[order], far[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], far[kept]


def _nearest(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        for batch in batches:
            column = batch.column(1)
            rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            sizes = np.diff(column.offsets.to_numpy())[rows]
            if (sizes != q.shape[1]).any():
                raise ValueError(f"vectors must have {q.shape[1]} components, as the queries have")
            x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            names = batch.column(0).take(pa.array(rows))
            for a in range(0, len(q), 128):
                d = np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in q[a : a + 128]])
                n = min(k, d.shape[1])
                edge = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                row, col = np.nonzero(d <= edge)
                far = d[row, col]
                if len(row) > n * len(d):
                    row, col, far = chosen(row, col, far, names, n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + row)), names.take(pa.array(col)), pa.array(far)], names=["query_id", "id", "distance"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, place (from 1) of the ``k`` nearest of ``vectors`` (id, embedding) to each of ``queries`` (query_id, vector).

    Null vectors take no part on either side; ties go to the smaller id. Vectors of different widths are an error. The queries are gathered on the
    driver, a block at a time.
    """
    held = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    vectors = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = f"query_id {held.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"
    ids = to_arrow_type(held.schema["query_id"].dataType)
    rows, pairs = held.toLocalIterator(), None
    while block := list(itertools.islice(rows, BROADCAST_QUERIES)):
        widths = {len(r["vector"]) for r in block}
        if len(widths) > 1:
            raise ValueError(f"query vectors of different widths: {sorted(widths)}")
        matrix = (pa.array([r["query_id"] for r in block], ids), np.array([r["vector"] for r in block], np.float64))
        some = vectors.mapInArrow(_nearest(vectors.sparkSession.sparkContext.broadcast(matrix), k), schema)
        pairs = some if pairs is None else pairs.union(some)
    if pairs is None:
        pairs = vectors.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def stretched(found: DataFrame) -> DataFrame:
    """``found`` with column score, per query_id: similarities from 0 (worst) to 1 (best) if they spread, else as they are."""
    mine = Window.partitionBy("query_id")
    low, high = F.min("similarity").over(mine), F.max("similarity").over(mine)
    return found.withColumn("score", F.when(high - low > SPREAD, (F.col("similarity") - low) / (high - low)).otherwise(F.col("similarity")))


def vector_search(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """query_id, id, similarity, score, place of the nearest ``limit`` of each query."""
    near = nearest(queries, vectors, limit)
    return stretched(near.select("query_id", "id", distance_to_similarity(F.col("distance")).alias("similarity"), "place"))
