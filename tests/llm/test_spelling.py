"""Spelling variants against the comparison of all pairs."""

import random
import zlib

import numpy as np
import pytest

from lanternbase.llm.spelling import roots, shortened, spelling_variants, variants, vocabulary


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int], ratio: int) -> dict:
    form, out = {}, {}
    for w, n in words.items():
        by = [x for x in words if near(w, x)]
        best = min(by, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(by), form[w], words.get(form[w]))
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w] += (end,)
    return out


def found(df) -> dict:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_words_of_few_letters(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 1, 2, 9, 10, 20, 100, 1000, 1000]) for _ in range(400)}
    long = "".join(rng.choice("ab") for _ in range(30_000))
    words |= {long: 3, long[:9] + long[10:]: 30, "z" * 20_000: 2, "z" * 19_999: 5}
    want = brute(words, 10)
    got = found(variants(spark.createDataFrame(list(words.items()), "word string, n long"), 10))
    assert got == want
    # there are chains, words without near words, and words with many
    assert any(w[4] != w[2] and w[2] for w in want.values()) and {w[1] for w in want.values()} > {0, 1, 2, 3}


def test_a_long_chain_has_one_root(spark):
    chain = [(f"{'a' * i}{'b' * (12 - i)}", 10**i) for i in range(13)]
    got = found(variants(spark.createDataFrame(chain, "word string, n long")))
    assert {v[4] for v in got.values()} == {"a" * 12}
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "rank long, root long")
    assert {r.root for r in roots(links).collect()} == {40}


def test_vocabulary(spark):
    texts = [(1, "Übermäßig ÜBERMÄSSIG übermäßig abcdefg1abcdefg × sixsix"), (2, "abcdefg abcdefgh-abcdefgh ABCDEFG"), (None, "abcdefg"), (3, None), (4, "")]
    want: dict[str, int] = {}
    for i, text in texts:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split(" "):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if run and i is not None and h % 2 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] = want.get(run, 0) + 1
    got = {r.word: r.n for r in vocabulary(spark.createDataFrame(texts, "doc_id long, text string"), occurrences=1, wear=2).collect()}
    assert got == want and len(want) > 3
    assert spelling_variants(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)


def test_hashes_are_of_the_shortened_words():
    words = ["abca", "bca", "aca", "aba", "abc", "aa", "a"]
    codes = np.array([ord(c) for w in words for c in w], np.int64)
    less, whole = shortened(codes, np.array([len(w) for w in words]))
    key = {w: tuple(whole[:, i]) for i, w in enumerate(words)}
    assert [tuple(less[:, i]) for i in range(4)] == [key[w] for w in words[1:5]] and len(set(key.values())) == len(words)
    at = sum(map(len, words[:5]))
    assert tuple(less[:, at]) == tuple(less[:, at + 1]) == key["a"]
