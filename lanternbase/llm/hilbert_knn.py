"""Approximate nearest neighbours by inner product over shifted Hilbert orderings.

Each of ``CURVES`` curves projects the vectors on ``AXES`` random orthonormal directions, makes the coordinates about uniform,
shifts them by a random offset and orders them along a Hilbert curve. The orderings are range-partitioned and sorted
by Spark; a prefix sum over the partitions' row counts gives every entry its place, and places are cut into blocks of
``WINDOW`` entries. A query is compared with the blocks around its place on every curve by exact inner products, and the curves' best
are merged. How many blocks each way is measured, not fixed: ``PROBES`` queries are answered exactly by one pass over the table, and
the reach is the least at which ``TARGET`` of their true neighbours lie near enough on a curve (one block at least). Up to ``STEP`` blocks make one
group, so that a far reach copies a query to few of them; every table is searched along the curves, whatever its size. A vector longer than another can have a larger
inner product at a wider angle; so the orderings use the vectors with one coordinate more that makes them all of the
greatest length, and the queries with zero there and scaled to that length.

Equal vectors form one class, which is ordered once and keeps its ``k`` + 1 smallest ids: a result of ``k`` with ties to
the smaller id can't hold others. The query's own id is left out at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stash, width

K, CURVES, AXES, BITS, WINDOW, SEED = 20, 16, 6, 8, 2048, 20
#: Queries whose exact neighbours set the reach, and the share of those that it must cover: above the promised 0.9 by a margin for the sample.
PROBES, TARGET = 128, 0.95
#: Blocks of one group, at most: a group is compared in one task.
STEP = 16
#: Classes, at most, from which the centre and the spread of the projections are taken: those of the least hashes.
SAMPLE = 4096
NEAR = "query long, cand long, score double"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, axes), ``bits`` bits a coordinate; Skilling's transform."""
    x = x.T.astype(np.int64).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for axis in x:
            hit = (axis & q) != 0
            swap = np.where(hit, 0, (x[0] ^ axis) & (q - 1))
            x[0] ^= np.where(hit, q - 1, swap)
            axis ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> b & 1)
    return key


class Orderings:
    """The curves over vectors of one dimension, fitted on a sample of them."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int, axes: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.longest, self.bits = longest, bits
        d = sample.shape[1] + 1
        axes = min(axes, d)
        self.turns = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, :axes] for _ in range(curves)]
        self.shifts = [rng.random(axes) for _ in range(curves)]
        placed = [self.lengthened(sample) @ t for t in self.turns]
        self.centres = [y.mean(axis=0) for y in placed]
        self.spreads = [np.maximum(y.std(axis=0), 1e-12) for y in placed]

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))[:, None]])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1))[:, None]
        return np.hstack([x * (self.longest / norm), np.zeros((len(x), 1))])

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, curves) of vectors that are lengthened or scaled already."""
        out = []
        for turn, shift, centre, spread in zip(self.turns, self.shifts, self.centres, self.spreads, strict=True):
            y = (x @ turn - centre) / spread
            even = 0.5 * (1 + np.tanh(0.7978845608 * (y + 0.044715 * y**3)))
            cell = np.clip((even + shift) / 2 * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
            out.append(hilbert(cell, self.bits))
        return np.stack(out, axis=1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vector (doubles as bytes) of the usable rows."""
    for batch in batches:
        column = batch.column(1)
        keep = column.is_valid().to_numpy(zero_copy_only=False)
        size = np.diff(column.offsets.to_numpy())
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        begin = column.offsets.to_numpy()[:-1]
        keep &= size > 0
        ids, vectors = [], []
        usable = np.isfinite(values)
        for i in np.flatnonzero(keep):
            v = values[begin[i] : begin[i] + size[i]]
            if usable[begin[i] : begin[i] + size[i]].all() and v.any():
                ids.append(batch.column(0)[i].as_py())
                vectors.append((v + 0.0).tobytes())  # -0.0 is 0.0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "vector"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _place(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            m = model.value
            parts = [(ids, False, m.keys(m.lengthened(x))), (ids[asks], True, m.keys(m.scaled(x[asks])))]
            for some, asking, keys in parts:
                n, c = keys.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(c, dtype=np.int32), n)), pa.array(keys.reshape(-1)), pa.array(np.repeat(some, c)), pa.array(np.full(n * c, asking))],
                    names=["curve", "key", "id", "asks"],
                )

    return run


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the ``k`` best of each row, all ties of the last one among them resolved to the smaller id."""
    if score.shape[1] <= k:
        return np.argsort(-score, axis=1, kind="stable")
    last = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
    out = np.empty((len(score), k), np.int64)
    for i, row in enumerate(score):
        some = np.flatnonzero(row >= last[i] - 1e-9 * abs(last[i]))
        out[i] = some[np.lexsort((ids[some], -row[some]))[:k]]
    return out


def _compare(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asks.any() and not asks.all():
            x, ids = _matrix(table.column("vector")), table.column("id").to_numpy()
            q, v, qi, vi = x[asks], x[~asks], ids[asks], ids[~asks]
            order = np.argsort(vi, kind="stable")
            v, vi = v[order], vi[order]
            once = np.concatenate([[True], vi[1:] != vi[:-1]])
            v, vi = v[once], vi[once]
            got = []
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                best = _top(part @ v.T, vi, k)
                # the products again, summed in one fixed order, so that each pair has one score wherever it is met
                exact = (part[:, None, :] * v[best]).sum(axis=2)
                got.append((np.repeat(qi[a : a + 256], best.shape[1]), vi[best].reshape(-1), exact.reshape(-1)))
            out = [np.concatenate([g[i] for g in got]) for i in range(3)]
        return pa.table({"query": pa.array(out[0]), "cand": pa.array(out[1]), "score": pa.array(out[2])})

    return run


def _probe(queries, k: int):
    """The ``k`` best of each partition for each of the broadcast queries (ids, matrix); one class has one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, q = queries.value
        for batch in batches:
            if len(batch):
                x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
                score = q @ x.T
                best = _top(score, ids, k)
                got = (np.repeat(qi, best.shape[1]), ids[best].reshape(-1), np.take_along_axis(score, best, axis=1).reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query", "cand", "score"])

    return run


def reach_of(spot: DataFrame, data: DataFrame, k: int, window: int, probes: int = PROBES, target: float = TARGET) -> int:
    """Blocks each way that cover ``target`` of the exact ``k`` neighbours of a sample of the queries; ``spot``: curve, id, asks, spot."""
    some = data.where("asks").orderBy(F.xxhash64("id"), "id").select("id", "vector").limit(probes).toPandas()
    if not len(some):
        return 1
    queries = data.sparkSession.sparkContext.broadcast((some["id"].to_numpy(), np.frombuffer(b"".join(map(bytes, some["vector"])), np.float64).reshape(len(some), -1)))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "cand")
    exact = data.select("id", "vector").mapInArrow(_probe(queries, k + 1), NEAR).where("query <> cand").withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k)
    exact = stash(exact.select("query", "cand"))
    mine = spot.where("asks").select(F.col("id").alias("query"), "curve", F.col("spot").alias("here")).join(F.broadcast(exact.select("query").distinct()), "query")
    theirs = spot.where("not asks").select(F.col("id").alias("cand"), "curve", F.col("spot").alias("there")).join(F.broadcast(exact.select("cand").distinct()), "cand")
    apart = exact.join(mine, "query").join(theirs, ["cand", "curve"]).groupBy("query", "cand").agg(F.min(F.abs(F.col("here") - F.col("there"))).alias("apart"))
    far = np.sort(apart.select("apart").toPandas()["apart"].to_numpy())
    return max(1, -(-int(far[min(len(far) - 1, int(np.ceil(target * len(far))))]) // window)) if len(far) else 1


def neighbours(vectors: DataFrame, every: int = 20, k: int = K, curves: int = CURVES, axes: int = AXES, bits: int = BITS, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row of ``vectors`` (vec_id, embedding) whose id ``every`` divides.

    Nearest is the largest inner product in double precision, ties to the smaller id; a row is never its own neighbour; with k or fewer
    others, all are found. Null, empty, zero and non-finite vectors take no part, nor rows without an id, nor vectors of another
    dimension than most (of the larger one, if two are as frequent). Rows with the same id and vector count once; of one id's different
    vectors each takes part, and none is a neighbour of another. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    usable = stash(only(vectors, "vec_id", "embedding").where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(_pack, "vec_id long, vector binary").distinct())
    sizes = usable.groupBy(F.octet_length("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.octet_length("vector") == sizes["size"])
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = usable.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    classes = stash(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    # two ids' vectors may share a least id only if one id has several vectors: classes are told apart by their vectors, then
    classes = classes.withColumn("id", F.when(F.count("*").over(Window.partitionBy("id")) == 1, F.col("id")).otherwise(F.xxhash64("vector")))
    asked = stash(usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").join(classes.select("vector", "id"), "vector").select("query_id", "id"))
    data = stash(classes.join(asked.select("id").distinct().withColumn("asks", F.lit(True)), "id", "left").select("id", "vector", F.coalesce("asks", F.lit(False)).alias("asks"), "ids"))
    sample = data.orderBy(F.xxhash64("id"), "id").select("vector").limit(SAMPLE).toPandas()["vector"]
    x = np.frombuffer(b"".join(map(bytes, sample)), np.float64).reshape(len(sample), -1)
    x = x[np.lexsort(x.T)]
    longest = data.select("vector").mapInArrow(_longest, "longest double").agg(F.max("longest")).first()[0]
    model = spark.sparkContext.broadcast(Orderings(x, longest, curves, axes, bits, seed))
    n = width(spark)
    entries = stash(data.select("id", "vector", "asks").mapInArrow(_place(model), "curve int, key long, id long, asks boolean"))
    ordered = stash(entries.repartitionByRange(n, "curve", "key", "id", "asks").sortWithinPartitions("curve", "key", "id", "asks").withColumn("at", F.monotonically_increasing_id()))
    # places: partition in the upper bits, row in the lower; one count for each curve in each partition
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy("curve", part.alias("part")).agg(F.count("*").alias("n"), F.min(row).alias("from"))
    upto = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("curve", "part", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("from")).alias("base"), F.sum("n").over(Window.partitionBy("curve")).alias("all"))
    spot = ordered.withColumn("part", part).join(F.broadcast(base), ["curve", "part"]).select("curve", "id", "asks", "all", (F.col("base") + row).alias("spot"))
    spot = stash(spot)
    reach = reach_of(spot, data, k, window)
    # groups of ``step`` blocks: those within ``-(-reach // step)`` of a query's own hold all blocks within its reach
    step = min(reach, STEP)
    far, block = -(-reach // step), F.floor(F.col("spot") / (window * step))
    near = F.when(F.col("asks"), F.sequence(block - far, block + far)).otherwise(F.array(block))
    homes = spot.select("id", "asks", "curve", "all", F.explode(near).alias("block")).where((F.col("block") >= 0) & (F.col("block") * (window * step) < F.col("all")))
    packed = homes.groupBy("id", "asks").agg(F.collect_list(F.struct("curve", "block")).alias("homes"))
    laid = packed.join(data.select("id", "vector"), "id").select("id", "asks", "vector", F.explode("homes").alias("home")).select("home.curve", "home.block", "id", "asks", "vector")
    groups = laid.repartition(2 * n, "curve", "block").groupBy("curve", "block")
    found = groups.applyInArrow(_compare(k + 1), NEAR).groupBy("query", "cand").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "cand")
    some = found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).drop("n")
    wide = some.join(data.select(F.col("id").alias("cand"), "ids"), "cand").select("query", "score", F.explode("ids").alias("vec_id"))
    finest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = wide.withColumn("n", F.row_number().over(finest)).where(F.col("n") <= k + 1)
    lists = stash(top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list")))
    mine = asked.distinct().join(lists, asked["id"] == lists["query"]).select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return mine.select("query_id", F.posexplode("list").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            x = _matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1).max()))])], names=["longest"])
