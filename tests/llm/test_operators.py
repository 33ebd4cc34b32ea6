"""The other operators against brute force, exact round trips and held-out accuracy."""

import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternbase.llm.bytesops import PAD, pack_ints, pack_sorted, unpack_ints, unpack_sorted
from lanternbase.llm.hilbert_knn import hilbert, neighbours
from lanternbase.llm.hilbert_knn import reach_of as _reach_of
from lanternbase.llm.components import forest
from lanternbase.llm.image_copies import edited, features, image_copies, linked, read_pgm, rendered, resized, write_pgm
from lanternbase.llm.ngram_lm import ALPHA, MU, cross_entropy_difference
from lanternbase.llm.packing import pack
from lanternbase.llm.quality import accepted, fit, held_out, score, statistics, teaching, train
from lanternbase.llm import quality, segment_sampling
from lanternbase.llm.segment_sampling import Pieces, decode_segmentations, default_path as piece_path, sample, sample_segmentations
from lanternbase.llm.tokens import default_path
from lanternbase.llm.wordpiece_counts import Automaton, piece_counts


def test_packed_integers():
    rng = random.Random(1)
    for n in (0, 1, 7, 1000):
        v = np.array(sorted(rng.getrandbits(rng.choice([3, 40, 64])) for _ in range(n)), np.uint64)
        assert (unpack_ints(pack_ints(v)) == v).all() and (unpack_sorted(pack_sorted(v)) == v).all()


TEXTS = [None, "", " ", "Hello  world", "a  b", "naïve “quoted” 日本 🙂", "<|endoftext|> x", "it's 12,3\n\n next\t tab", "x" * 3000, "word " * 4000]


@pytest.mark.parametrize("length", [64, 100])
def test_packing(spark, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    rows = [(i if i % 4 else None, t, i) for i, t in enumerate(TEXTS * 2)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, N int").repartition(3), length).collect()
    want = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _ in rows)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == length or s == len(sequences) - 1
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
    by_size: dict[int, list] = {}
    for k in want:
        by_size.setdefault(len(k), []).append(k)
    assert all(r.ids_crc32 in {zlib.crc32(np.array(k[r.start : r.start + r.length], "<u4").tobytes()) for k in by_size[r.doc_tokens]} for r in got)
    assert Counter(r.doc_tokens for r in got if r.start == 0) == Counter(len(k) for k, n in want.items() for _ in range(n))
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labelled(n: int):
    rng = random.Random(n)
    words = [f"{a}{b}" for a in ("st", "me", "la", "ko") for b in ("ra", "ti", "no", "en")]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        good = rng.random() < 0.6
        if not good:
            w = rng.choice([[w[0]] * len(w), [x + "%%%" for x in w], [x.upper() + "!!" for x in w]])
        rows.append((i, " ".join(w), int(good)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(None, None), (5000, ""), (5001, "x " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(None, 1), (3, None), (7, rows[7][2])], "doc_id long, quality int")
    assert {r[0] for r in teaching(labels).collect() if r[0] is not None} == {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 3 != 1}
    model = train(docs, teaching(labels), sample=500)
    got = score(docs.withColumn("TEXT2", F.lit(1)), model).join(docs.select("doc_id").distinct(), "doc_id").select("doc_id", "score", held_out(F.col("doc_id")).alias("h")).collect()
    truth = {d: q for d, _, q in rows}
    held = [r for r in got if r.h and r.doc_id in truth]
    assert len(held) > 200 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    kept = accepted(docs, model)
    assert kept.columns == docs.columns
    assert np.mean([truth[r.doc_id] for r in kept.where("doc_id < 5000").collect()]) > 0.97


def test_quality_without_labels():
    assert fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 60))).tolist() == [0.5, 0.5]
    x = statistics([b"a b c", b""])
    assert np.isfinite(x).all() and fit(x, np.ones(2)).score(x)[0] == pytest.approx(0.75)


def test_quality_of_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert score(docs, model).count() == 0 and model.score(statistics([b"some text", b""])).tolist() == [0.5, 0.5]


def brute_trees(x, y, trees):
    """Boosting by trying every cut of every node on its own rows; a tree is a nested tuple that is walked row by row."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    rate = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(rate / (1 - rate)))

    def grow(rows, grad, hess, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        best, cut = 1e-6, None
        for j in range(x.shape[1]) if depth else ():
            for edge in edges[j]:
                low = rows[x[rows, j] <= edge]
                gl, hl = grad[low].sum(), hess[low].sum()
                gain = gl**2 / (hl + quality.L2) + (g - gl) ** 2 / (h - hl + quality.L2) - g**2 / (h + quality.L2)
                if min(hl, h - hl) >= quality.LEAST / 4 and gain > best + 1e-9:
                    best, cut = gain, (j, edge)
        if cut is None:
            return -quality.RATE * g / (h + quality.L2)
        below = x[rows, cut[0]] <= cut[1]
        return (*cut, grow(rows[below], grad, hess, depth - 1), grow(rows[~below], grad, hess, depth - 1))

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), quality.DEPTH)
        margin += [walk(tree, row) for row in x]
    return 1 / (1 + np.exp(-margin))


def test_trees_equal_brute_force():
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 5, 300), rng.exponential(size=300), np.zeros(300)])
    y = ((x[:, 0] * x[:, 2] + 0.3 * x[:, 1] + rng.normal(0, 0.5, 300)) > 0.6).astype(float)
    got = fit(x, y, trees=8)
    assert 0.2 < y.mean() < 0.8 and (got.left > 0).sum() > 20
    assert np.allclose(got.score(x), brute_trees(x, y, 8), atol=1e-9)


def brute_losses(rows, target):
    def tokens(text):
        return (text or "").encode().lower().split() + [b"</s>"]

    def model(docs):
        word, pair, context = Counter(), Counter(), Counter()
        for t in docs:
            before = b"<s>"
            context[before] += 1
            for w in tokens(t):
                word[w] += 1
                pair[before, w] += 1
                before = w
        return word, pair, context

    v = len(model([t for _, t in rows])[0])
    out = []
    for i, (d, t) in enumerate(rows):
        others = rows[:i] + rows[i + 1 :]
        both = []
        for word, pair, context in (model([x for _, x in others]), model([x for k, x in others if k in target])):
            n, total, before = 0, 0.0, b"<s>"
            for w in tokens(t):
                c = context[before] if before == b"<s>" else word[before]
                total -= math.log((pair[before, w] + MU * (word[w] + ALPHA) / (sum(word.values()) + ALPHA * v)) / (c + MU))
                before, n = w, n + 1
            both.append(total / n)
        out.append((d, n, round(both[1], 9), round(both[0], 9)))
    return sorted(out, key=str)


def test_language_model_scores(spark):
    rng = random.Random(3)
    rows = [(i if i % 9 else None, rng.choice([None, "", *[" ".join(rng.choice("ABab cD") for _ in range(rng.randrange(60))) for _ in range(8)]])) for i in range(60)]
    rows += rows[:4]
    target = {1, 2, 3, 5, 8, 13, 21, 34}
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int").repartition(3)
    got = cross_entropy_difference(docs, spark.createDataFrame([(x,) for x in [*target, 5, None, 999]], "doc_id long"), partition_bytes=300).collect()
    assert sorted([(r.doc_id, r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9)) for r in got], key=str) == brute_losses(rows, target)
    assert all(r.score == r.target_loss - r.background_loss for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert cross_entropy_difference(empty, empty).count() == 0


def greedy(vocabulary, word):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocabulary), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_word_piece_counts(spark):
    rng = random.Random(4)
    for _ in range(100):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 15))}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14))) for _ in range(30)]
        size = np.array([len(w) for w in words])
        assert Automaton(vocabulary).counts(b"".join(words) + PAD, np.cumsum(size) - size, size).tolist() == [greedy(vocabulary, w) for w in words]
    from lanternbase.llm.tokens import token_bytes

    with open(default_path(), encoding="utf-8") as f:
        vocabulary = set(token_bytes(json.load(f)))
    rows = list(enumerate([t[:300] if t else t for t in TEXTS]))
    got = {r.doc_id: (r.n_words, r.n_pieces) for r in piece_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {d: (t or "").encode().split() for d, t in rows}
    assert got == {d: (len(w), sum(greedy(vocabulary, x) for x in w)) for d, w in words.items()}


def test_hilbert_curve_is_continuous():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    key = hilbert(side, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_of_few_vectors_are_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8)) * rng.uniform(0.2, 3, (150, 1))
    x[40:80] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0]), (None, x[0].tolist()), (220, []), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got: dict = {}
    for r in neighbours(df, every=20, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 150, 20))
    for q, hits in got.items():
        s = x @ x[q]
        want = sorted((-round(s[i], 9), i) for i in range(150) if i != q)[:7]
        assert [(i, v) for i, v, _ in sorted(hits)] == [(n + 1, v) for n, (_, v) in enumerate(want)]
        assert all(abs(v - s[i]) < 1e-9 for _, i, v in hits)
    assert neighbours(df.limit(0)).count() == 0
    assert neighbours(df.where("vec_id in (20, 21)"), k=5).count() == 1


def test_neighbours_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours(df, every=200, k=10, window=256).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    hits = [len(got[q] & set(np.argsort(-np.where(np.arange(4000) == q, -np.inf, x @ x[q]))[:10].tolist())) for q in got]
    assert len(hits) == 20 and np.mean(hits) / 10 >= 0.9


@pytest.mark.parametrize("n,curves", [(12000, 2), (6000, 16)])  # wider reach; compared whole
def test_neighbours_recall_does_not_fall_with_rows(spark, n, curves):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours(df, every=100, k=10, window=32 if curves == 16 else 512, curves=curves).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & set(np.argsort(-np.where(np.arange(n) == q, -np.inf, x @ x[q]))[:10].tolist())) for q in got]
    assert len(hits) == n // 100 and np.mean(hits) / 10 >= 0.9


def test_neighbours_take_the_curves_at_every_size(spark, monkeypatch):
    """A reach that covers the table keeps to the blocks of the curves, in groups of a bounded number of them."""
    from lanternbase.llm import hilbert_knn

    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, compare = [], hilbert_knn._compare
    monkeypatch.setattr(hilbert_knn, "STEP", 2)
    monkeypatch.setattr(hilbert_knn, "reach_of", lambda *a, **k: seen.append(_reach_of(*a, **k)) or seen[-1])

    def counting(k):
        run = compare(k)

        def noted(table):
            assert len(set(table.column("curve").to_pylist())) == 1 and table.column("asks").to_pylist().count(False) <= 2 * 32
            return run(table)

        return noted

    monkeypatch.setattr(hilbert_knn, "_compare", counting)
    got: dict = {}
    for r in neighbours(df, every=100, k=10, window=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & set(np.argsort(-np.where(np.arange(3000) == q, -np.inf, x @ x[q]))[:10].tolist())) for q in got]
    assert seen[0] > 2 and len(hits) == 30 and np.mean(hits) / 10 >= 0.9


@pytest.fixture(scope="module")
def pieces():
    with open(piece_path(), "rb") as f:
        return Pieces(f.read())


def all_segmentations(pieces, text):
    text = pieces.normalize(text)

    def walk(i):
        if i == len(text):
            yield 0.0, ()
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in pieces.ids:
                one = (pieces.ids[text[i:j]],)
            elif j == i + 1:
                one = tuple(pieces.byte[b] for b in text[i].encode())
            else:
                continue
            for q, rest in walk(j):
                yield sum(pieces.log_p[x] for x in one) + q, one + rest

    found = dict((ids, p) for p, ids in walk(0))
    total = math.log(sum(math.exp(p) for p in found.values()))
    return {ids: p - total for ids, p in found.items()}


@pytest.mark.parametrize("long", [128, 2])  # all steps together; all but the first two word by word
def test_samples_follow_the_distribution(pieces, long, monkeypatch):
    monkeypatch.setattr(segment_sampling, "LONG", long)
    want = all_segmentations(pieces, "the c🙂")
    first, inclusion = Counter(), Counter()
    n = 6000
    for i in range(n):
        got = sample(pieces, "the c🙂", 3, i)
        assert len({tuple(x[0]) for x in got}) == 3
        assert [x[2] for x in got] == sorted((x[2] for x in got), reverse=True)
        for ids, p, _, q in got:
            assert abs(want[tuple(ids)] - p) < 1e-9 and 0 < q <= 1
            inclusion[tuple(ids)] += 1 / q
        first[tuple(got[0][0])] += 1
    for ids, p in sorted(want.items(), key=lambda x: -x[1])[:3]:
        assert abs(first[ids] / n - math.exp(p)) < 4 * math.sqrt(math.exp(p) / n) + 0.002
        assert abs(inclusion[ids] / n - 1) < 0.1  # inverse inclusion weights are unbiased


def test_words_are_cut_from_octets_as_from_characters(pieces):
    texts = ["", "a", " a  b ", "  ", "é▁ß ☁🙂 ", "\u2580\u2582 x", "ends ", " begins", "", "日本 語"]
    texts = [pieces.normalize(t) for t in texts]
    words, size = segment_sampling._words(texts)
    want = [re.findall("▁*[^▁]+|▁+", t) for t in texts]
    assert words.to_pylist() == [w for x in want for w in x] and size.tolist() == list(map(len, want))
    assert segment_sampling._words([])[1].tolist() == []


@pytest.mark.parametrize("texts", [[""], ["", ""], ["a", "", "one two three four five six seven eight nine ten"]])
def test_samples_beside_texts_without_words(pieces, texts):
    seeds = np.arange(len(texts), dtype=np.uint64)
    got = [[] for _ in texts]
    for some, ids, ends, *scores in segment_sampling.sample_together(pieces, texts, seeds, 4):
        for i, t in enumerate(some.tolist()):
            got[t].append((ids[ends[i - 1] if i else 0 : ends[i]].tolist(), *(float(x[i]) for x in scores)))
    assert got == [sample(pieces, t, 4, i) for i, t in enumerate(texts)]


def test_the_query_segments_documents(spark, tmp_path):
    from lanternbase.llm.queries import QUERIES

    rows = [(1, "a star"), (2, None), (3, "lano koti " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = decode_segmentations(QUERIES["op9_segment_sampling"](spark, str(tmp_path))).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and all(r.decoded == (dict(rows)[r.doc_id] or "") for r in got)
    assert Counter(r.doc_id for r in got) == {1: 4, 2: 1, 3: 4}


def test_segmentations(spark):
    texts = [None, "", "a", "hello world  twice", "日本 🙂 naïve", "line\nbreak\ttab"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = decode_segmentations(sample_segmentations(df, ["id"], k=5)).collect()
    assert all(r.decoded == (texts[r.id] or "") for r in got)
    by = Counter((r.id, r["sample"], tuple(r.ids), r.log_prob) for r in got)
    assert all(n == (2 if k[0] == 3 else 1) for k, n in by.items())
    assert {r.id for r in got} == set(range(6)) and sum(r.id == 1 for r in got) == 1
    assert sample_segmentations(df.limit(0), ["id"]).count() == 0


def test_image_copies(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(4):
        b = np.kron(rng.uniform(0, 255, (9, 9)), np.ones((12, 12)))
        edited = b * 0.85 + 10
        edited[40:60, 40:60] = 200
        rows += [(10 * i, write_pgm(b)), (10 * i + 1, write_pgm(b)), (10 * i + 2, write_pgm(b[10:90, 14:100])), (10 * i + 3, write_pgm(edited)), (10 * i + 4, write_pgm(np.rot90(b)))]
    rows += [(900, None), (901, b""), (902, b"P5 3"), (None, rows[0][1]), (0, rows[0][1]), (903, write_pgm(np.zeros((2, 2))))]
    got = {r.id: r for r in image_copies(spark.createDataFrame([(*r, 1) for r in rows], "id long, image binary, n int")).collect()}
    assert len(got) == 24
    assert all(got[10 * i + j].class_id == 10 * i for i in range(4) for j in range(5))
    assert got[900].class_id == got[901].class_id == 900 and got[902].class_id == 902 and got[903].n_features == 0
    assert image_copies(spark.createDataFrame([], "id long, image binary")).count() == 0
    assert read_pgm(b"P5\n# note\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]


def textured(rng, side=9, block=12):
    return np.kron(rng.uniform(0, 255, (side, side)), np.ones((block, block)))


def classes_of_all_pairs(rows):
    """Class of each id, by judging every pair of images."""
    described = {i: features(read_pgm(data)) for i, data in rows}
    a, b = zip(*[(i, j) for i, j in itertools.combinations(sorted(described), 2) if linked(described[i], described[j])], strict=True)
    root = dict(zip(*map(list, forest(np.array(a), np.array(b))), strict=True))
    return {i: root.get(i, i) for i in described}


@pytest.mark.parametrize("limits", [{}, {"small": 3, "bucket": 20}])  # large buckets; dealt out as pairs of blocks
def test_image_classes_equal_those_of_all_pairs(spark, limits):
    rng = np.random.default_rng(2)
    rows = []
    for group, size in ((0, 60), (100, 25), (200, 1), (300, 2)):
        base = textured(rng)
        rows += [(group + i, write_pgm(base + rng.normal(0, 3, base.shape))) for i in range(size)]
    tile = np.tile(textured(rng, 5, 8), (3, 3))  # each motif many times: one image has equal features
    rows += [(400, write_pgm(tile)), (401, write_pgm(0.9 * tile)), (402, write_pgm(tile[8:, 16:]))]
    got = {r.id: r.class_id for r in image_copies(spark.createDataFrame(rows, "id long, image binary"), **limits).collect()}
    assert got == classes_of_all_pairs(rows) and {got[i] for i in (400, 401, 402)} == {400} and got[59] == 0


def test_unrelated_images_with_repeating_corners_stay_apart():
    """Block textures have corners at the same places, and motifs of few blocks that look alike."""
    rng = np.random.default_rng(11)
    described = [features(read_pgm(write_pgm(textured(rng)))) for _ in range(90)]
    assert not [pair for pair in itertools.combinations(range(90), 2) if linked(described[pair[0]], described[pair[1]])]


def test_a_shared_part_and_a_resized_copy_are_linked():
    rng = np.random.default_rng(12)
    image = textured(rng, 20, 12)
    left, right = (features(read_pgm(write_pgm(part))) for part in (image[:, :150], image[:, 90:]))
    assert linked(left, right) and linked(left, features(read_pgm(write_pgm(resized(image, 1.3)))))


def test_edited_images_of_vectors_are_linked(spark):
    """Every kind of edit that the registered query makes, of images as it draws them, and no other link."""
    rng = np.random.default_rng(13)
    rows = [(i, (v / np.linalg.norm(v)).tolist(), i % 4) for i, v in enumerate(rng.normal(size=(80, 64)))]
    drawn = spark.createDataFrame(rows, "id long, embedding array<double>, kind int").select("id", "kind", rendered("embedding").alias("image"))
    copies = drawn.select((F.col("id") + 1000).alias("id"), edited("image", "kind").alias("image"))
    got = {r.id: r.class_id for r in image_copies(drawn.select("id", "image").unionByName(copies)).collect()}
    assert len(got) == 160 and all(got[i] == i for i in range(80)) and all(got[i + 1000] in (i, i + 1000) for i in range(80))
    caught = [sum(got[i + 1000] == i for i in range(k, 80, 4)) for k in range(4)]
    assert min(caught) >= 16 and sum(caught) >= 74


def test_op1_links_its_edited_copies(spark):
    from lanternbase.llm.queries import EDITED, EDITED_ONE_IN, op1_image_copies

    sf_dir = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = op1_image_copies(spark, sf_dir).collect()
    plain, copies = [r for r in got if r.edit is None], [r for r in got if r.edit is not None]
    assert len(plain) == n and all(r.class_id == r.id == r.vec_id for r in plain)
    assert all(r.id == r.vec_id + EDITED and r.class_id in (r.id, r.vec_id) for r in copies)
    assert not copies or sum(r.class_id == r.vec_id for r in copies) >= 0.8 * len(copies)
    assert len(copies) <= 4 * n / EDITED_ONE_IN


def test_crop_of_a_large_image(spark):
    rng = np.random.default_rng(5)
    large = textured(rng, 40, 12)
    rows = [(1, write_pgm(large)), (2, write_pgm(large[200:290, 300:400])), (3, write_pgm(textured(rng, 40, 12)))]
    got = {r.id: r for r in image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert [got[i].class_id for i in (1, 2, 3)] == [1, 1, 3] and got[1].n_features > 500


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = labelled(300)
    passage = " ".join(f"common{i}" for i in range(60))
    good = [d for d, _, q in rows if q]
    texts = {d: t for d, t, _ in rows}
    words = random.Random(9)
    for d in good:
        texts[d] = " ".join(words.choice(["star", "tino", "meen", "lara", "koti", "lano"]) + str(words.randrange(1000))[:1] for _ in range(80))
    texts[good[5]], texts[good[6]] = texts[good[0]], texts[good[1]] + " " + passage
    texts[good[7]] = passage + " " + texts[good[7]]
    docs = spark.createDataFrame([(d, texts[d], "en", "s", len(texts[d])) for d in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "packing"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        at = spark.read.parquet(str(tmp_path / f"out{i}"))
        kept.append({r.doc_id: r.text for r in at.collect()})
    assert len(set(kept[0]) & set(good)) > 0.97 * len(good) and len(set(kept[0]) - set(good)) < 5
    assert set(kept[0]) - set(kept[1]) == {good[5]}
    # the sixth repeats the first text and is the first with the passage, which the seventh loses
    assert kept[2][good[6]] == passage and kept[2][good[7]] == texts[good[7]].removeprefix(passage + " ")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(kept[2])
