"""Fingerprints, links, and both substring operators against brute force."""

import random

import numpy as np
import pytest
import xxhash

from lanternbase.llm.components import components
from lanternbase.llm.repeats import ByteUnits, WordUnits, repeated
from lanternbase.llm.rlz_dedup import cut_spans, parse, remove_spans
from lanternbase.llm.simhash import deduplicate, fingerprints, hexadecimal, keys, links, simhash_groups
from lanternbase.llm.suffix_dedup import maximal_repeats, remove_repeats


def brute_fingerprint(text: bytes, k: int = 4) -> int:
    w = text.lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fp: list[int], ids: list[int | None], distance: int = 4) -> list[int | None]:
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    best: dict[int, int] = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(fp))]


def test_fingerprints_equal_the_definition():
    rng = random.Random(1)
    docs = [b" ".join(rng.choice([b"aa", b"B", b"C" * 40, "é".encode()]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 9, 300, 700)]
    docs += [b"\t\n \x0b\x0c\r", b"a\x0bb\x0cc\rd e", b"x" * 5000]
    assert [int(x) for x in fingerprints(docs)] == [brute_fingerprint(d) for d in docs]


@pytest.mark.parametrize("errors", range(5))
def test_fingerprints_within_four_bits_share_a_key(errors):
    rng = np.random.default_rng(errors)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, errors, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    found = []
    for fp in (x, y):
        row, key = keys(fp)
        found.append([set(key[row == i]) for i in range(len(fp))])
    assert all(a & b for a, b in zip(*found, strict=True))


def corpus(rng: random.Random) -> list[tuple]:
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randrange(0, 200))] for _ in range(8)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            if w:
                w[rng.randrange(len(w))] = "edit"
        rows.append((rng.choice([i, i, i, i % 7, None]), rng.choice([" ".join(w)] * 8 + [None, "", " \n", "ONE", "one two three"])))
    return rows


@pytest.mark.parametrize("bucket", [4, 4096])
def test_simhash_classes(spark, bucket):
    rows = corpus(random.Random(bucket))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, Root string").repartition(3)
    got = simhash_groups(df, bucket=bucket).select("doc_id", hexadecimal("fp").alias("f"), "component_id").collect()
    fp = [brute_fingerprint((t or "").encode()) for _, t in rows]
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fp, brute_classes(fp, [d for d, _ in rows]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = deduplicate(df, bucket=bucket)
    assert kept.columns == df.columns
    assert {c for _, _, c in want if c is not None} == {r[0] for r in kept.select("doc_id").collect() if r[0] is not None}


def test_simhash_of_no_rows(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (1000, 1001)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in root if find(v) != v}


def test_links_in_large_buckets(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for _ in range(300)})
    got = links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=16)
    assert components(got).select("a").count() == len(fps) - 1


def brute_removal(rows, units, window):
    first, docs = {}, [(d, units((t or "").encode())) for d, t in rows]
    for d, u in docs:
        for i in range(len(u) - window + 1 if d is not None else 0):
            k = bytes(u[i : i + window]) if isinstance(u, bytes) else tuple(u[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, u in docs:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1 if d is not None else 0):
            k = bytes(u[i : i + window]) if isinstance(u, bytes) else tuple(u[i : i + window])
            if first[k] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        out.append((d, len(u), sum(gone), bytes(kept) if isinstance(u, bytes) else b" ".join(kept)))
    return sorted(out, key=str)


def passages(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.randrange(20, 120))) for _ in range(6)]
    rows: list[tuple] = []
    for i in range(100):
        parts = [rng.choice([rng.choice(pool), "".join(rng.choice("abcdéfgh \n\t") for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(6))]
        text = rng.choice(["".join(parts)] * 5 + [None, "", rows[-1][1] if rows else "", "a" * rng.randrange(200), "ab " * rng.randrange(100)])
        rows.append((rng.choice([i, i, i, rng.randrange(40), None, -i]), text))
    return rows


@pytest.mark.parametrize("hot", [3, 10**6])
def test_substring_operators(spark, hot):
    rows = passages(hot)
    df = spark.createDataFrame([(d, t, 0, b"") for d, t in rows], "doc_id long, text string, key int, kept binary").repartition(3)
    got = remove_repeats(df, least=24, hot=hot, partition_bytes=900)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got.collect()], key=str) == brute_removal(rows, lambda b: b, 24)
    assert all(sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) == r.n_removed for r in got.collect())
    got = remove_spans(df, window=12, hot=hot, partition_bytes=900)
    want = brute_removal(rows, lambda b: b.split(), 12)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()], key=str) == want
    cut = cut_spans(df.withColumnRenamed("key", "n_chars"), window=12, hot=hot, partition_bytes=900)
    assert cut.columns == ["doc_id", "text", "n_chars", "kept"] and cut.count() == len(rows)
    texts = {(d, t) for d, t in rows}
    for r in cut.collect():
        assert (r.doc_id, r.text) in texts or r.n_chars == len(r.text)
    left = sorted((r.doc_id, b" ".join((r.text or "").encode().split())) for r in cut.collect() if r.doc_id is not None)
    assert left == sorted((d, k) for d, _, _, k in want if d is not None)


def test_substring_operators_of_no_rows_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == remove_spans(empty).count() == cut_spans(empty).count() == 0
    long = "".join(random.Random(1).choice("abcd efgh") for _ in range(1_500_000))
    df = spark.createDataFrame([(1, long), (2, long[700_000:])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(df).collect()} == {1: 0, 2: 800_000}


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 5))]
        least = 3
        got = set()
        for r in maximal_repeats(texts, least):
            for g, n in enumerate(r.length):
                at = r.group == g
                got.add((int(n), frozenset(zip(r.text[at].tolist(), r.start[at].tolist(), strict=True))))
        where: dict[bytes, set] = {}
        for t, text in enumerate(texts):
            for i in range(len(text)):
                for j in range(i + least, len(text) + 1):
                    where.setdefault(text[i:j], set()).add((t, i))
        want = set()
        for s, places in where.items():
            if len(places) < 2:
                continue
            left = {texts[t][i - 1] if i else (-1, t) for t, i in places}
            right = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else (-1, t) for t, i in places}
            ends = any(i == 0 for _, i in places), any(i + len(s) == len(texts[t]) for t, i in places)
            if (len(left) > 1 or ends[0]) and (len(right) > 1 or ends[1]):
                want.add((len(s), frozenset(places)))
        assert want == got


def test_factors_agree_with_their_references():
    rng = random.Random(7)
    pool = [rng.choice("abcdef") for _ in range(300)]
    texts = []
    for _ in range(12):
        a = rng.randrange(200)
        texts.append(" ".join(pool[a : a + 80] + [rng.choice("xyz") for _ in range(10)]).encode())
    f = parse(texts, np.zeros(12, np.int64), np.arange(12), 20)
    words = [t.split() for t in texts]
    assert len(f.text)
    for t, s, n, rt, rs in zip(f.text, f.start, f.length, f.ref_text, f.ref_start, strict=True):
        assert n >= 20 and rt < t and words[t][s : s + n] == words[rt][rs : rs + n]


def test_a_text_that_stands_for_two_gives_the_repeats_of_both():
    rng = random.Random(12)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) * rng.randrange(1, 4) for _ in range(5)]
        twice = np.array([rng.random() < 0.4 for _ in texts])
        places = [i for i in range(5)] + [i for i in range(5) if twice[i]]
        name = {k: (k if k < 5 else 5 + places[k]) for k in range(len(places))}

        def repeats(parts, rename):
            out = set()
            for r in parts:
                for g in range(len(r.length)):
                    mine = r.group == g
                    out.add((int(r.length[g]), frozenset((rename[int(t)], int(s)) for t, s in zip(r.text[mine], r.start[mine], strict=True))))
            return out

        got = repeats(maximal_repeats(texts, 5, twice=twice), {i: i for i in range(10)})
        want = repeats(maximal_repeats([texts[i] for i in places], 5), name)
        assert got == want


@pytest.mark.parametrize("units", [ByteUnits(), WordUnits()])
def test_nothing_is_removed_but_by_the_solver(spark, units):
    words = " ".join(f"word{i}" for i in range(200))
    rows = [(1, words), (2, words), (3, "start " + words), (4, words + " end"), (5, words)]
    nothing = np.zeros(0, np.int64)
    got = repeated(spark.createDataFrame(rows, "doc_id long, text string"), units, lambda *_: (nothing, nothing, nothing), hot=2).collect()
    assert len(got) == 3 and all(not r.n_removed and not r.copy_removed for r in got)
