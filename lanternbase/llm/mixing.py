"""Mixing sources to target weights by a flow of least cost.

Documents may belong to several sources. They are counted by membership pattern (the set of their sources); each pattern can give its
words several times, and each further slice of a repetition costs more than the one before. A flow of least cost sends the patterns' words
to the quotas of the sources, for each connected set of sources by itself. What a pattern gives is taken from its documents in an order drawn from a
seed: all of them as often as it goes, then the first of the order once more, the last of these in part.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stash
from .components import components

WEIGHTS, SHARE, REPEATS, SLICES, SEED = (3.0, 1.0, 2.0), 1.5, 2, 4, 0
#: Hex digits of the order whose ranges are counted, one after the other, before the range that holds the bound is looked at row by row.
RANGES = (2, 4, 6)
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> DataFrame:
    """source, source_size, target of ``sources`` (source, source_size; one row each).

    In the order of their names by code point, null last, sources take the ``weights`` in turn. They share ``share`` times the sum of all sizes by weight;
    a target stops at ``most`` times its source's size, and what is above goes to the others by weight until none is above. Windows run
    over one row for each source.
    """
    if min(weights) <= 0 or not 0 <= share <= most:
        raise ValueError("weights must be positive and the share within 0 and the most that sources can give")
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1
    each = sources.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight"))
    # sources stop in the order of size by weight; the level of the others follows from what is left after the first that stop
    full = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(upto), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    each = each.select("*", full.alias("full"), (left / rest).alias("level"))
    # the first source that does not stop gives the level
    stops = F.col("weight") * F.col("level") > F.col("full")
    level = F.min(F.when(~stops, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level")))
    each = each.select("*", level.over(every)["level"].alias("at"))
    return each.select("source", "source_size", F.when(F.col("weight") * F.col("at") < F.col("full"), F.col("weight") * F.col("at")).otherwise(F.col("full")).alias("target"))


def flow(sizes: list[int], members: list[list[int]], quotas: list[int], repeats: int = REPEATS, slices: int = SLICES) -> dict[tuple[int, int], int]:
    """(pattern, source) to words: of all flows that fill the ``quotas`` as far as they can be filled, one of least cost.

    Pattern i has ``sizes[i]`` words and may give them ``repeats`` times to the sources ``members[i]``; word for word, slice number s of ``slices`` slices of
    a repetition costs s, counted from 0 over all repetitions. Shortest augmenting paths with potentials; paths are found from the sources' unfilled quotas.
    """
    n, m = len(sizes), len(quotas)
    start, end = n + m, n + m + 1
    to, room, cost, out = [], [], [], [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, capacity: int, price: int) -> None:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            out[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)

    for i, size in enumerate(sizes):
        for k in range(repeats * slices):
            part = size * (k % slices + 1) // slices - size * (k % slices) // slices
            if part:
                arc(start, i, part, k)
        for s in members[i]:
            arc(i, n + s, repeats * size, 0)
    for s, quota in enumerate(quotas):
        if quota:
            arc(n + s, end, quota, 0)
    potential = [0] * (n + m + 2)
    while True:
        far, via = [None] * (n + m + 2), [-1] * (n + m + 2)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if room[e]:
                    v, at = to[e], d + cost[e] + potential[u] - potential[to[e]]
                    if far[v] is None or at < far[v]:
                        far[v], via[v] = at, e
                        heapq.heappush(heap, (at, v))
        if far[end] is None:
            break
        highest = max(d for d in far if d is not None)
        potential = [p + (highest if d is None else d) for p, d in zip(potential, far, strict=True)]
        # along the path, as much as its narrowest arc takes
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        some = min(room[e] for e in path)
        for e in path:
            room[e] -= some
            room[e ^ 1] += some
    return {(u, to[e] - n): room[e ^ 1] for u in range(n) for e in out[u] if e % 2 == 0 and n <= to[e] < n + m and room[e ^ 1]}


def _solve(repeats: int, slices: int):
    def run(arcs: pd.DataFrame) -> pd.DataFrame:
        """arcs: group, pattern, source (keys), size, quota of one connected set."""
        arcs = arcs.sort_values(["pattern", "source"])
        patterns, sources = arcs.drop_duplicates("pattern"), arcs.drop_duplicates("source")
        at = {s: i for i, s in enumerate(sources["source"])}
        members = [[at[s] for s in g] for _, g in arcs.groupby("pattern", sort=True)["source"]]
        got = flow([int(x) for x in patterns["size"]], members, [int(x) for x in sources["quota"]], repeats, slices)
        p, s = patterns["pattern"].tolist(), sources["source"].tolist()
        return pd.DataFrame([(p[i], s[k], n) for (i, k), n in got.items()], columns=["pattern", "source", "words"])

    return run


def route(patterns: DataFrame, quotas: DataFrame, repeats: int = REPEATS, slices: int = SLICES) -> DataFrame:
    """pattern, source, words: what each pattern gives to each source.

    patterns: pattern (long), size, members (array of sources); quotas: source, target. Patterns and sources that hang together are solved in one task, from a row for each
    pattern and source: their number follows from how sources overlap, not from the number of documents.
    """
    key = F.xxhash64(F.lit("source"), F.col("source").isNull(), "source")
    arcs = patterns.select("pattern", "size", F.explode("members").alias("source")).withColumn("key", key)
    quota = quotas.select(key.alias("key"), F.round("target").cast("long").alias("quota"))
    arcs = stash(arcs.join(quota, "key"))
    groups = stash(components(arcs.select(F.col("pattern").alias("a"), F.col("key").alias("b"))))
    root = F.coalesce("b", "pattern")
    apart = arcs.join(groups, F.col("pattern") == F.col("a"), "left").select(root.alias("group"), "pattern", F.col("key").alias("source"), "size", "quota")
    solved = apart.groupBy("group").applyInPandas(_solve(repeats, slices), "pattern long, source long, words long")
    return solved.withColumnRenamed("source", "key").join(arcs.select("pattern", "key", "source"), ["pattern", "key"]).select("pattern", "source", "words")


def select(rows: DataFrame, given: DataFrame) -> DataFrame:
    """``rows`` (doc_id, size, pattern, draw) with column taken, so that each pattern's taken words are what it gives (pattern, size, words).

    draw (hex digits) orders the rows of a pattern, ties by doc_id and size. Sums of ranges of the order tell in which the bound falls, 256 ranges, then 256 of that one, and so
    on; only the rows of the last range, one in 16 million, are ordered one by one, so a pattern with most of all rows is spread like any other.
    """
    bound = given.where("size > 0").select("pattern", F.floor(F.col("words") / F.col("size")).alias("full"), F.pmod("words", "size").alias("rest"), F.lit("").alias("at"), F.lit(0).cast("long").alias("before"))
    # written, so that Spark knows its size and sends it to the rows if it is small, instead of dealing the rows by pattern
    bound = stash(bound)
    within = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    for digits in RANGES:
        inside = rows.join(bound, "pattern").where(F.startswith("draw", "at"))
        ranges = inside.groupBy("pattern", "full", "rest", "before", F.substring("draw", 1, digits).alias("range")).agg(F.sum("size").alias("held"))
        ranges = ranges.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(within), F.lit(0)))
        # the range that holds the first word that is not taken once more
        bound = stash(ranges.where("before <= rest and rest < before + held").select("pattern", "full", "rest", F.col("range").alias("at"), "before"))
    each = rows.join(bound, "pattern", "left")
    own = F.coalesce(F.col("full"), F.lit(0)) * F.col("size")
    prefix = F.substring("draw", 1, RANGES[-1])
    clear = each.where(F.col("at").isNull() | (prefix != F.col("at"))).select("doc_id", "pattern", "size", (own + F.when(prefix < F.col("at"), F.col("size")).otherwise(0)).alias("taken"))
    one = Window.partitionBy("pattern").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(one), F.lit(0))
    close = each.where(prefix == F.col("at")).select("doc_id", "pattern", "size", (own + F.greatest(F.lit(0), F.least(F.col("size"), open_))).alias("taken"))
    return clear.unionByName(close)


def mix(
    docs: DataFrame,
    members: Column,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    slices: int = SLICES,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: taken (doc_id, size, sources, taken) of each row of ``docs`` (doc_id, text), sources (source, source_size, target), and the flows (sources, source, words).

    ``members`` is the array of a row's sources, null among them like any other; a row without sources is never taken. A source's size is that of all its
    rows; one text counts for each of its sources. No row is taken more than ``repeats`` times; where sources overlap, a quota that can't be filled is filled as far as
    it goes. Null and empty texts have size 0 and nothing is taken of them; texts are counted whole. Rows with the same doc_id are drawn together, a null doc_id
    like any other. Extra columns are ignored; an empty table gives empty tables. Results depend on the rows and the seed alone.
    """
    flat = docs.select("*", F.array_sort(F.array_distinct(members)).alias("_members"))
    flat = only(flat, "doc_id", "text", "_members")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    pattern = F.xxhash64(F.transform("sources", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit(""))))
    rows = flat.select("doc_id", words(F.col("text")).alias("size"), F.col("_members").alias("sources"))
    rows = stash(rows.select("doc_id", "size", "sources", pattern.alias("pattern"), draw.alias("draw")))
    patterns = stash(rows.groupBy("pattern").agg(F.first("sources").alias("members"), F.sum("size").alias("size")).where("size(members) > 0"))
    sizes = patterns.select("size", F.explode("members").alias("source")).groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stash(targets(sizes, weights, share, repeats))
    flows = stash(route(patterns, goals, repeats, slices))
    given = flows.groupBy("pattern").agg(F.sum("words").alias("words")).join(patterns.select("pattern", "size"), "pattern")
    named = patterns.select("pattern", F.col("members").alias("sources"))
    taken = select(rows.select("doc_id", "size", "pattern", "draw"), given).join(named, "pattern", "left")
    return taken.select("doc_id", "size", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "taken"), goals, flows.join(named, "pattern").select("sources", "source", "words")
