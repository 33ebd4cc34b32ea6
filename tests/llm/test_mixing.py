"""Mixing: targets against reshare by reshare, flows against all flows, selection against one pass over the sorted rows."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from lanternbase.llm.mixing import flow, mix, targets


def reshared(sizes: dict, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped: dict = {}
    while True:
        left, rest = share * sum(sizes.values()) - sum(stopped.values()), sum(w for s, w in weight.items() if s not in stopped)
        each = {s: weight[s] * left / rest for s in names if s not in stopped}
        above = [s for s, t in each.items() if t > most * sizes[s] + 1e-9]
        if not above:
            return stopped | each
        stopped |= {s: most * sizes[s] for s in above}


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 20):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 5, 100, 10_000, 1_000_000]) for i in range(n)} | {"é": 17}
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = reshared(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in got), (sizes, got, want)
    assert [r.target for r in targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).collect()] == [0, 0]


def cost(sizes, got, repeats, slices) -> int:
    total = 0
    for i, size in enumerate(sizes):
        used = sum(n for (p, _), n in got.items() if p == i)
        for k in range(repeats * slices):
            part = size * (k % slices + 1) // slices - size * (k % slices) // slices
            total += k * min(part, used)
            used -= min(part, used)
        assert used == 0
    return total


def test_flow_is_full_and_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        sizes, quotas = [rng.randrange(0, 4) for _ in range(3)], [rng.randrange(0, 6) for _ in range(2)]
        members = [rng.choice([[0], [1], [0, 1]]) for _ in sizes]
        arcs = [(i, s) for i, m in enumerate(members) for s in m]
        got = flow(sizes, members, quotas, 2, 2)
        best = None
        for amounts in itertools.product(*[range(min(2 * sizes[i], quotas[s]) + 1) for i, s in arcs]):
            some = dict(zip(arcs, amounts, strict=True))
            if all(sum(n for (i, _), n in some.items() if i == p) <= 2 * sizes[p] for p in range(3)) and all(sum(n for (_, s), n in some.items() if s == q) <= quotas[q] for q in range(2)):
                rank = (-sum(amounts), cost(sizes, some, 2, 2))
                best = rank if best is None else min(best, rank)
        assert (-sum(got.values()), cost(sizes, got, 2, 2)) == best


def test_large_overlapping_flow():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 10**9) for _ in range(300)]
    members = [sorted(rng.sample(range(8), rng.randrange(1, 4))) for _ in sizes]
    quotas = [int(sum(sizes) * 1.2 / 8)] * 8
    got = flow(sizes, members, quotas)
    assert [sum(n for (_, s), n in got.items() if s == q) for q in range(8)] == quotas
    used = [sum(n for (i, _), n in got.items() if i == p) for p in range(300)]
    # slices of a repetition cost more and more, so patterns are used about evenly
    assert all(0.75 * x <= u <= 1.5 * x for x, u in zip(sizes, used, strict=True))


def test_taken_rows(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", "b", "b", None, "c"])) for i in range(600)] + [(7, "twice w", "a"), (7, "twice w", "a"), (None, "no id", "b"), (601, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, sources, flows = mix(df, F.array("source"))
    goal = {r.source: (r.source_size, r.target) for r in sources.collect()}
    want = []
    for s, (total, target) in goal.items():
        assert total == sum(len((t or "").split()) for _, t, x in rows if x == s)
        full, rest = divmod(round(target), total)
        own = sorted((hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, len((t or "").split())) for i, t, x in rows if x == s)
        for _, i, n in own:
            more = max(0, min(n, rest))
            rest -= n
            want.append((i, n, s or "", full * n + more))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.sources[0] or "", r.taken) for r in taken.collect())
    assert got == sorted(want)
    again = mix(df.repartition(7, "text"), F.array("source"))[0]
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.sources[0] or "", r.taken) for r in again.collect())
    assert {r.source: r.words for r in flows.collect()} == {s: round(t) for s, (_, t) in goal.items()}


def test_overlapping_sources(spark):
    rng = random.Random(6)
    kinds = [["web"], ["web", "news"], ["news"], ["code", None], ["code"], [], None]
    rows = [(i, "x " * rng.randrange(1, 50), rng.choice(kinds)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    taken, sources, flows = mix(df, F.col("of"), share=0.6)
    got = {r.doc_id: r for r in taken.collect()}
    assert len(got) == 1500 and all(r.taken <= 2 * r["size"] for r in got.values())
    assert all(r.taken == 0 for r in got.values() if not r.sources)
    # every quota is met; what documents give is what flows from their patterns
    goal = {r.source: round(r.target) for r in sources.collect()}
    flow_ = [(tuple(r.sources), r.source, r.words) for r in flows.collect()]
    assert {s: sum(w for _, x, w in flow_ if x == s) for s in goal} == goal and set(goal) == {"web", "news", "code", None}
    assert all(s in p for p, s, _ in flow_)
    for p in {p for p, _, _ in flow_}:
        assert sum(r.taken for r in got.values() if tuple(r.sources) == p) == sum(w for x, _, w in flow_ if x == p)
