"""Token alignment: texts cut into cells against whole texts, encoded and compared token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lanternbase.llm.alignment import Sides, align, alignment, cells, default_pieces
from lanternbase.llm.tokens import default_path

ODD = ["", " ", "  ", "a ", " a", "a  b", "a \n b", "\n", "a\n b", "a   b", "x▁ y", "▁", "<s> </s> <unk> <0x0A>", "a <|endoftext|> b", "日本語 テキスト", "é🙂 ﬀ́", "it's 'll  \t\t x", "a  b", "0 1 22 333", "a\x1c b\x85 c", "end   "]


@pytest.fixture(scope="module")
def sides():
    with open(default_path(), encoding="utf-8") as f, open(default_pieces(), "rb") as g:
        return Sides(f.read(), g.read())


def brute(sides, texts):
    """n_a, n_b, n_groups, links and digest of whole texts."""
    for text in texts:
        a = sides.first.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sides.second.encode(text) if text else []
        whole = b" " + (text or "").encode()
        if not text or b"".join(sides.bytes_a[i] for i in a) != whole or b"".join(sides.bytes_b[i] for i in b) != whole:
            yield 0, 0, 0, [], ""
            continue
        ends = [np.cumsum([len(names[i]) for i in ids]).tolist() for names, ids in ((sides.bytes_a, a), (sides.bytes_b, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[], []] for _ in cuts]
        for side, ids in enumerate((a, b)):
            at = 0
            for i, end in zip(ids, ends[side], strict=True):
                groups[at][side].append(str(i))
                at += end == cuts[at]
        links = [(a[ends[0].index(c)], b[ends[1].index(c)]) for c in cuts] if len(cuts) < 3000 else [(dict(zip(ends[0], a, strict=True))[c], dict(zip(ends[1], b, strict=True))[c]) for c in cuts]
        yield len(a), len(b), len(cuts), links, hashlib.sha256(";".join("|".join(map(",".join, g)) for g in groups).encode()).hexdigest()


def test_alignment_equals_whole_texts(spark, sides):
    rng = random.Random(8)
    parts = ["the", "The", "naïve", "Übung", " ", "  ", "\n", "\t", "'s", "12", "...", "foo_bar", "été", "strawberry", "🙂", "x" * 40, " ", "(a)"]
    texts = [*ODD, None, *["".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(1, 60))) for _ in range(300)], "word " * 500, "word " * 500]
    want = list(brute(sides, texts))
    count = Counter(link for w in want for link in w[3])
    best: dict[int, int] = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for chunk in (24 << 20, 1000):
        got = {r.doc_id: r for r in alignment(df, chunk_bytes=chunk).collect()}
        assert len(got) == len(texts)
        for i, (n_a, n_b, n_groups, links, digest) in enumerate(want):
            r = got[i]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, len(links), digest), texts[i]
            assert (r.n_best, r.count_sum) == (sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links)), texts[i]
    # U+2581 becomes a space on one side only
    assert got[ODD.index("▁")].n_a == 0 and got[ODD.index("<s> </s> <unk> <0x0A>")].n_a > 0 and 0 < sum(w[0] > 0 for w in want) < len(want)


def test_cells_put_together_are_the_text():
    for text in [*ODD[1:], "a b  c \n d", "x " * 5]:
        found = cells(text)
        assert " ".join(found) == text and (found == [text] or found[-1])


def test_groups_and_places():
    group_a, group_b, at_a, at_b = align(np.array([2, 3, 6, 7]), np.array([1, 3, 4, 5, 7]))
    assert group_a.tolist() == [0, 0, 1, 1] and group_b.tolist() == [0, 0, 1, 1, 1] and at_a.tolist() == [1, 3] and at_b.tolist() == [1, 4]


def test_large_ids_and_null_ids_stay(spark):
    df = spark.createDataFrame([(2**62 + 1, "one two"), (None, "one two"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment(df).collect()}
    assert set(got) == {2**62 + 1, None, 5} and got[None].count_sum == got[2**62 + 1].count_sum > 0 and got[5].n_a == 0
