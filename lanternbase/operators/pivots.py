"""Exact nearest neighbours that read a part of the vectors: cells around pivots, skipped by the triangle inequality.

Each vector belongs to its nearest pivot's cell and is stored with its distance from it (r), sorted by cell and r, so that a filter on both reaches the row groups' statistics. For a query at
distance d of a pivot, a vector at r from it is at |d - r| or more; and a vector of a cell is at half or more of what the query is nearer to its own pivot than to the cell's. A first pass
over each query's nearest cells gives k vectors and with them a distance that no result exceeds; a second one reads the rings that may hold nearer ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lanternbase.operators.vector import chosen

#: Pivots at most; they are drawn by hash from the vectors and go to all tasks, as do QUERIES queries at a time.
PIVOTS, QUERIES = 256, 2_000
#: Vectors that a cell should hold at least.
CELL = 500
#: Distances are sums in double precision: bounds give way by so much.
SLACK = 1e-9


def _matrix(rows: list, what: str) -> np.ndarray:
    widths = {len(r) for r in rows}
    if len(widths) > 1:
        raise ValueError(f"{what} of different widths: {sorted(widths)}")
    return np.array(rows, np.float64).reshape(len(rows), -1)


def _block(batch: pa.RecordBatch, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose vector is not null, and their vectors."""
    column = batch.column(at)
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(rows) and (np.diff(column.offsets.to_numpy())[rows] != width).any():
        raise ValueError(f"vectors must have {width} components")
    return rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - v) ** 2).sum(axis=1))


def _assign(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            rows, x = _block(batch, 1, p.shape[1])
            cell, r = np.zeros(len(rows), np.int32), np.full(len(rows), np.inf)
            for i, v in enumerate(p):
                d = distances(x, v)
                nearer = d < r
                cell[nearer], r[nearer] = i, d[nearer]
            took = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(r), took.column(0), took.column(1)], names=["cell", "r", "id", "embedding"])

    return run


class PivotIndex:
    """Vectors (id, embedding) under a path: ``pivots``, ``cells`` (cell, n, least, most) and ``vectors`` (cell, r, id, embedding)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, vectors: DataFrame, pivots: int = PIVOTS) -> None:
        """Null vectors are left out; vectors of different widths are an error. The pivots are a sample of at most ``pivots`` vectors, fewer where cells would hold less than CELL."""
        held = vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = held.count()
        few = max(1, min(pivots, n // CELL))
        drawn = [r["embedding"] for r in held.orderBy(F.xxhash64("id"), "id").limit(few).collect()]
        matrix = _matrix(drawn, "vectors")
        self.spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(matrix)], "cell int, pivot array<double>").coalesce(1).write.parquet(f"{self.path}/pivots")
        schema = f"cell int, r double, id {held.schema['id'].dataType.simpleString()}, embedding array<double>"
        assigned = held.mapInArrow(_assign(self.spark.sparkContext.broadcast(matrix)), schema)
        # cells of any size are split by distance from the pivot, so rows of a crowded cell do not meet in one task
        ring = F.floor(F.col("r") * 64)
        rows = assigned.repartition("cell", ring).sortWithinPartitions("cell", "r")
        rows.write.option("parquet.block.size", 1 << 20).parquet(f"{self.path}/vectors")
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/vectors")
        stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).coalesce(1).write.parquet(f"{self.path}/cells")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """The same rows as ``vector.nearest``: query_id, id, distance, place of the ``k`` nearest to each of ``queries`` (query_id, vector); ties to the smaller id."""
        return self._nearest(queries, k, None)

    def nearest_counting(self, queries: DataFrame, k: int) -> tuple[DataFrame, dict[str, int]]:
        """``nearest``, and how many rows there are, in the cells of the first pass, and in the rings of the second, summed over blocks of QUERIES queries."""
        told = {"rows": 0, "first": 0, "second": 0}
        return self._nearest(queries, k, told), told

    def _nearest(self, queries: DataFrame, k: int, told: dict[str, int] | None) -> DataFrame:
        vectors = self.spark.read.parquet(f"{self.path}/vectors")
        p = _matrix([r["pivot"] for r in self.spark.read.parquet(f"{self.path}/pivots").orderBy("cell").collect()], "pivots")
        cells = {r["cell"]: r for r in self.spark.read.parquet(f"{self.path}/cells").collect()}
        held = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        kind = to_arrow_type(held.schema["query_id"].dataType)
        schema = f"query_id {held.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"
        rows, parts = held.toLocalIterator(), []
        while block := list(itertools.islice(rows, QUERIES)):
            q, ids = _matrix([r["vector"] for r in block], "query vectors"), pa.array([r["query_id"] for r in block], kind)
            if q.shape[1] != p.shape[1]:
                raise ValueError(f"vectors must have {p.shape[1]} components")
            parts.append(self._searched(vectors, p, cells, q, ids, k, schema, told))
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, place int")
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def _searched(self, vectors: DataFrame, p: np.ndarray, cells: dict, q: np.ndarray, ids: pa.Array, k: int, schema: str, told: dict[str, int] | None) -> DataFrame:
        d = np.stack([distances(q, v) for v in p], axis=1)
        known = np.array(sorted(cells))
        n, least, most = (np.array([cells[c][x] for c in known]) for x in ("n", "least", "most"))
        d, own = d[:, known], d.min(axis=1)
        # the nearest cells that hold k rows
        order = np.argsort(d, axis=1, kind="stable")
        enough = np.cumsum(n[order], axis=1) - n[order] < k
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, enough, axis=1)
        rings = np.where(first[:, :, None], np.array([-1.0, np.inf]), np.array([1.0, 0.0]))
        best = Window.partitionBy("query_id").orderBy("distance", "id")

        def cut(rows: DataFrame) -> DataFrame:
            return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)

        # k rows for each of QUERIES queries at most
        found = cut(self._read(vectors, known, rings, q, ids, k, schema)).drop("place").collect()
        edge, by = np.full(len(q), np.inf), {}
        for r in found:
            by.setdefault(r["query_id"], []).append(r["distance"])
        for i, name in enumerate(ids.to_pylist()):
            if len(got := by.get(name, [])) >= k:
                edge[i] = sorted(got)[k - 1]
        # rings of the other cells that can hold something as near
        reach = edge[:, None] * (1 + SLACK) + SLACK
        low, high = np.maximum(d - reach, -1.0), d + reach
        out = first | (low > most) | (high < least) | ((d - own[:, None]) / 2 > reach)
        second = np.where(out[:, :, None], np.array([1.0, 0.0]), np.stack([low, high], axis=2))
        if told is not None:
            told["rows"] += int(n.sum())
            told["first"] += int(n[first.any(axis=0)].sum())
            told["second"] += 0 if out.all() else vectors.where(self._rings(known, second)).count()
        whole = self.spark.createDataFrame(found, schema) if found else self.spark.createDataFrame([], schema)
        if not out.all():
            whole = whole.unionByName(self._read(vectors, known, second, q, ids, k, schema))
        return cut(whole)

    @staticmethod
    def _rings(known: np.ndarray, rings: np.ndarray) -> Column:
        """The cells and, of each, the range of r that any query asks for."""
        asked = rings[:, :, 0] <= rings[:, :, 1]
        low = np.where(asked, rings[:, :, 0], np.inf).min(axis=0)
        high = np.where(asked, rings[:, :, 1], -np.inf).max(axis=0)
        wanted = F.lit(False)
        for c, a, b in zip(known.tolist(), low.tolist(), high.tolist(), strict=True):
            if a <= b:
                wanted = wanted | ((F.col("cell") == c) & F.col("r").between(a, b))
        return wanted

    def _read(self, vectors: DataFrame, known: np.ndarray, rings: np.ndarray, q: np.ndarray, ids: pa.Array, k: int, schema: str) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((ids, q, {c: rings[:, i] for i, c in enumerate(known.tolist())}))
        return vectors.where(self._rings(known, rings)).mapInArrow(_rank(shared, k), schema)


def _rank(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, rings = shared.value
        for batch in batches:
            cell, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            _, x = _block(batch, 3, q.shape[1])
            mine: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                low, high = rings[c][:, 0], rings[c][:, 1]
                for i in np.flatnonzero(low <= high).tolist():
                    near = rows[(r[rows] >= low[i]) & (r[rows] <= high[i])]
                    if len(near):
                        mine.append((np.full(len(near), i), near, distances(x[near], q[i])))
            if mine:
                row, col, far = (np.concatenate(c) for c in zip(*mine, strict=True))
                row, col, far = chosen(row, col, far, batch.column(2), k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), batch.column(2).take(pa.array(col)), pa.array(far)], names=["query_id", "id", "distance"])

    return run
