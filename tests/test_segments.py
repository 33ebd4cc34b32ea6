"""The stored index: commits, postings, segments over several updates, embeddings by content, and searches that skip blocks."""

import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternbase.functions.models import HashModel, embedding_column
from lanternbase.operators import lexical, postings
from lanternbase.operators.segments import SegmentedIndex
from lanternbase.sources import commits

WORDS = ["alpha", "beta", "gamma", "délta", "foo_bar", "bar foo", "foo bar", "x1", "rare", "the", "common common common"]


def files(spark, contents: dict[str, str]):
    rows = [(p, c, 1.0, len(c)) for p, c in contents.items()]
    return spark.createDataFrame(rows, "path string, content string, mtime double, size long")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def ranked(df):
    return sorted((r.query_id, r.place, r.id, round(r.score, 9)) for r in df.collect())


def same_as_scan(index, queries, limit=7):
    want = ranked(lexical.keyword_search(queries, index.chunks().select("id", "text"), limit))
    got = ranked(index.search(queries, limit))
    assert got == want
    assert ranked(index.search(queries, limit, prune=True)) == want
    return want


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, n)))


QUERIES = ("alpha beta", "foo_bar", "delta", "rare", "common common", "__ alpha", "missing alpha", "the", "bar_foo alpha", "Alpha alpha gamma")


def test_searches_equal_a_scan_over_rounds_of_edits(spark, tmp_path):
    rng = random.Random(1)
    index, contents = SegmentedIndex(spark, str(tmp_path), fanout=3), {f"memory/{i}.md": f"# T{i}\n{text(rng, 40)}\n## S\n{text(rng, 9)}\n" for i in range(90)}
    assert index.update(files(spark, contents), "m") == {"indexed": 90, "skipped": 0, "deleted": 0}
    queries = asked(spark, *QUERIES)
    sizes = []
    for edits in range(3):
        for i in rng.sample(range(90), 5):
            contents[f"memory/{i}.md"] = f"# New {edits}\n{text(rng, 30)} rare\n"
        for i in rng.sample(range(90), 3):
            contents.pop(f"memory/{i}.md", None)
        contents[f"memory/more{edits}.md"] = f"{text(rng, 20)}\n"
        before = set(index.written())
        told = index.update(files(spark, contents), "m")
        assert told["indexed"] >= 6 and sum(told.values()) - told["deleted"] == len(contents)
        assert {r.path for r in index.files().collect()} == set(contents) == {r.path for r in index.chunks().select("path").distinct().collect()}
        sizes.append((len(index.state()), len(set(index.written()) - before)))
    assert same_as_scan(index, queries)
    # small segments were merged on the way, and the first, large one was not written again
    assert any(new == 2 for _, new in sizes) and index.state()[0]["docs"] == 180 and len(index.state()) <= 3
    fresh = SegmentedIndex(spark, str(tmp_path / "fresh"))
    fresh.update(files(spark, contents), "m")
    assert fresh.stats() == index.stats() and ranked(fresh.search(queries, 7)) == ranked(index.search(queries, 7))
    index.compact()
    assert len(index.state()) == 1 and index.state()[0]["dead_docs"] == 0 and fresh.stats() == index.stats()
    assert ranked(fresh.search(queries, 7)) == ranked(index.search(queries, 7))
    assert sorted(r.id for r in fresh.chunks().collect()) == sorted(r.id for r in index.chunks().collect())
    assert index.update(files(spark, contents), "m") == {"indexed": 0, "skipped": len(contents), "deleted": 0} and len(index.state()) == 1
    live = {s["name"] for s in index.state()}
    index.vacuum(keep=1, older_than_s=0)
    assert set(index.written()) == live and index.search(queries, 7).count() > 10
    index.close()


def test_what_is_written_follows_the_change(spark, tmp_path):
    rng = random.Random(2)
    contents = {f"{i}.md": " ".join(f"w{rng.randrange(3000)}" for _ in range(1500)) for i in range(300)}
    index = SegmentedIndex(spark, str(tmp_path))
    index.update(files(spark, contents), "m")

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "segments") for f in names)

    whole = size()
    contents["3.md"] = "one edit"
    del contents["4.md"]
    assert index.update(files(spark, contents), "m") == {"indexed": 1, "skipped": 298, "deleted": 1}
    assert size() - whole < whole / 10 and [s["dead_docs"] for s in index.state()] == [0, 2]


class Counting(HashModel):
    """Notes what it embeds in a file, as it runs in other processes; fails on texts with a word while a file is there."""

    def __init__(self, folder, width=8):
        super().__init__(width)
        self.folder = str(folder)

    def embed_many(self, texts):
        if any("bad" in t for t in texts) and os.path.exists(f"{self.folder}/broken"):
            raise ValueError("one of the texts")
        return [self.embed(t) for t in texts]

    def embed(self, text):
        if "bad" in text and os.path.exists(f"{self.folder}/broken"):
            raise ValueError("bad")
        with open(f"{self.folder}/asked", "a") as f:
            f.write(text.replace("\n", "|") + "\n")
        return super().embed(text)


def test_embeddings_are_stored_by_content(spark, tmp_path):
    model, index = Counting(tmp_path), SegmentedIndex(spark, str(tmp_path / "index"))
    embed = lambda c: embedding_column(model, c)

    def told():
        path = tmp_path / "asked"
        lines = path.read_text().splitlines() if path.exists() else []
        path.write_text("")
        return sorted(lines)

    (tmp_path / "broken").write_text("")
    contents = {"a.md": "# A\none\n# B\ntwo\n", "b.md": "# A\none\n", "c.md": "bad luck\n"}
    index.update(files(spark, contents), "m", embed)
    # equal inputs are asked for once
    assert told() == ["A||# A|one", "B||# B|two"]
    assert {r.path for r in index.chunks().where("embedding is null").collect()} == {"c.md"}
    # a section that moves to another place or file keeps its vector; a failed one is tried again, without an edit
    contents |= {"a.md": "# B\ntwo\n\n# A\none\n", "d.md": "# B\ntwo\n"}
    (tmp_path / "broken").unlink()
    assert index.update(files(spark, contents), "m", embed) == {"indexed": 2, "skipped": 2, "deleted": 0}
    assert told() == ["bad luck"]
    rows = index.chunks().collect()
    assert len(rows) == 5 and all(r.embedding is not None and r.embedding == pytest.approx(HashModel(8).embed(f"{r.text[2:3]}\n\n{r.text}" if r.text[0] == "#" else r.text)) for r in rows)
    assert index.update(files(spark, contents), "m", embed)["skipped"] == 4 and told() == []
    # force makes all chunks anew, with the vectors there are; another model has none
    index.update(files(spark, contents), "m", embed, force=True)
    assert told() == [] and index.stats()[0] == 5
    index.update(files(spark, contents), "n", embed, force=True)
    assert len(told()) == 3
    with pytest.raises(ValueError, match="widths"):
        index.update(files(spark, {**contents, "e.md": "new"}), "n", lambda c: embedding_column(Counting(tmp_path, 9), c))
    assert index.stats()[0] == 5


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    done = [threading.Thread(target=lambda k=k: [commits.transact(spark, root, lambda s, k=k, i=i: {"seen": [*s.get("seen", []), [k, i]]}) for i in range(5)]) for k in range(3)]
    for t in done:
        t.start()
    for t in done:
        t.join()
    number, state = commits.latest(spark, root)
    assert number == 15 and sorted(state["seen"]) == [[k, i] for k in range(3) for i in range(5)]
    assert not commits.commit(spark, root, 15, {}) and commits.read(spark, root, 15) == state
    assert commits.commit(spark, root, 1_000_000, {"late": 1}) and commits.commit(spark, root, 1_000_001, {"late": 2}) and commits.latest(spark, root) == (1_000_001, {"late": 2})


def test_a_writer_that_comes_second_makes_its_change_again(spark, tmp_path):
    one, two = SegmentedIndex(spark, str(tmp_path)), SegmentedIndex(spark, str(tmp_path))
    one.update(files(spark, {"a.md": "alpha"}), "m")
    extended = two._extended

    def meanwhile(*args):
        if meanwhile.first:
            meanwhile.first = False
            one.apply(spark.createDataFrame([("other", "h", 0.0, 1, False)], "path string, hash string, mtime double, size long, deleted boolean"), spark.createDataFrame([("i1", "other", 1, 1, "beta")], "id string, path string, start_line int, end_line int, text string"))
        return extended(*args)

    meanwhile.first, two._extended = True, meanwhile
    two.apply(spark.createDataFrame([("third", "h", 0.0, 1, False)], "path string, hash string, mtime double, size long, deleted boolean"), spark.createDataFrame([("i2", "third", 1, 1, "gamma")], "id string, path string, start_line int, end_line int, text string"))
    assert sorted(r.path for r in two.files().collect()) == ["a.md", "other", "third"] and two.stats()[0] == 3


def test_only_blocks_of_the_terms_are_read(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path))
    index.update(files(spark, {f"{i}.md": f"alpha w{i}" for i in range(20)}), "m")
    found = postings.with_terms(index._read(index.state(), "postings", postings.BLOCKS), spark.createDataFrame([(["alpha"],), (["w3"],)], "terms array<string>"))
    plan = found.select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [alpha,w3])]" in plan and "ReadSchema: struct<term:string,n:int>" in plan
    assert sorted((r.term, sum(x.n for x in found.collect() if x.term == r.term)) for r in found.select("term").distinct().collect()) == [("alpha", 20), ("w3", 1)]


def test_blocks_are_skipped(spark, tmp_path):
    """Spans of few occurrences can't reach the best documents of a span with many."""
    rows = [(f"{i:05d}", f"{i}", 1, 1, "needle " * (40 if 64 <= i < 80 else 1) + "hay " * 60) for i in range(64 * 40)]
    made = spark.createDataFrame(rows, "id string, path string, start_line int, end_line int, text string").coalesce(1)
    index = SegmentedIndex(spark, str(tmp_path))
    index.apply(made.select("path", F.lit("h").alias("hash"), F.lit(0.0).alias("mtime"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("deleted")), made)
    queries = asked(spark, "needle", "needle hay")
    got, counted = index.search_counting(queries, 10, prune=True)
    assert ranked(got) == ranked(lexical.keyword_search(queries, made.select("id", "text"), 10))
    for r in counted.collect():
        assert (r.spans, r["first"]) == (40, 5) and r.skipped >= 30, r


def test_tops_give_the_largest_score():
    rng = np.random.default_rng(3)
    block = np.sort(rng.integers(0, 30, 400))
    tf, dl = rng.integers(1, 9, 400).astype(np.int32), rng.integers(1, 99, 400).astype(np.int32)
    (offsets, tfs), (_, dls) = postings._tops(block, tf, dl, 30)
    for b in range(30):
        for mean in (1.0, 40.0, 300.0):
            score = lambda t, d: t * 2.2 / (t + 1.2 * (0.25 + 0.75 * d / mean))  # noqa: B023, E731
            own = score(tf[block == b], dl[block == b])
            top = score(tfs[offsets[b] : offsets[b + 1]], dls[offsets[b] : offsets[b + 1]])
            assert (len(own) == 0) == (len(top) == 0) and (not len(own) or own.max() == top.max())


def test_texts_of_results_are_read_by_id(spark, tmp_path):
    made = SegmentedIndex(spark, str(tmp_path / "index"), fanout=8)
    files = lambda texts: spark.createDataFrame([(f"{k}.md", v, 0.0, len(v)) for k, v in texts.items()], "path string, content string, mtime double, size long")
    made.update(files({"a": "red fox", "b": "red dog", "c": "blue fox"}), "none")
    made.update(files({"a": "red fox", "b": "red cat", "c": "blue fox"}), "none")
    found = made.search(spark.createDataFrame([(0, "red")], "query_id long, query string"), 5)
    shown = made.fetch(found, "path", "text")
    assert sorted((r.path, r.text) for r in shown.collect()) == [("a.md", "red fox"), ("b.md", "red cat")]
    assert "PushedFilters: [In(id, [" in shown._jdf.queryExecution().toString()
    # an id that is gone finds nothing, and no ids give no rows
    assert made.fetch(spark.createDataFrame([("gone",)], "id string"), "text").count() == 0 and made.fetch(found.limit(0), "text").count() == 0
