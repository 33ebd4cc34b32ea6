"""The retrieval engine: hand-written cases, invariants, and a differential test of BM25 against SQLite."""

import datetime
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lanternbase import cli, config
from lanternbase.functions import scores
from lanternbase.functions.models import HashModel, HostedModel
from lanternbase.functions.text import STOP_WORDS, query_phrases, query_tokens
from lanternbase.memory import Memory
from lanternbase.operators import conversation, hybrid, index, lexical, prompt, vector
from lanternbase.operators.chunk import chunks
from lanternbase.streaming.follow import follow


def test_chunks(spark):
    cases = {
        "a": "",
        "b": "pre\n# T\nx\n### S\ny\n## U\n\nz\n#### no\n#bad\n# \nq\n",
        "c": "# A\n\n\n",
        "d": "\n\n# A",
        "e": "# A\n## \n### C",
        "f": "# A\r\nx\r\n## B\r\n",
        "g": "```\n# x\n```",
    }
    want = {
        "b": [(1, 1, "", "pre"), (2, 3, "T", "# T\nx"), (4, 5, "T > S", "### S\ny"), (6, 10, "T > U", "## U\n\nz\n#### no\n#bad"), (11, 12, "", "# \nq")],
        "c": [(1, 3, "A", "# A")],
        "d": [(3, 3, "A", "# A")],
        "e": [(1, 1, "A", "# A"), (2, 2, "A > ", "##"), (3, 3, "A >  > C", "### C")],
        "f": [(1, 2, "A", "# A\nx"), (3, 3, "A > B", "## B")],
        "g": [(1, 1, "", "```"), (2, 3, "x", "# x\n```")],
    }
    got: dict = {}
    for r in chunks(spark.createDataFrame(list(cases.items()), "path string, content string")).collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.context, r.text))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_query_tokens(spark):
    cases = ["How do I find the rust compiler?", "a I the", "é x", "foo_bar", "fox fox", "__ fox", None]
    df = spark.createDataFrame([(c,) for c in cases], "q string")
    rows = df.select(query_tokens(F.col("q")), query_phrases(F.col("q"))).collect()
    assert [r[0] for r in rows] == [["rust", "compiler"], [], ["é"], ["foo_bar"], ["fox", "fox"], ["__", "fox"], []]
    assert rows[3][1] == [["foo", "bar"]] and rows[5][1] == [[], ["fox"]]
    assert len(STOP_WORDS) == 89


def test_scores(spark):
    x = spark.createDataFrame([(-3.0,), (1.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in x.select(scores.rank_to_score(F.col("x"))).collect()] == [0.75, 0.5, 0.001, 0.001, 0.001]
    d = spark.createDataFrame([(0.0,), (1.0,), (math.sqrt(2),), (2.0,)], "x double")
    assert [round(r[0], 9) for r in d.select(scores.distance_to_similarity(F.col("x"))).collect()] == [1, 0.5, 0, 0]
    paths = ["memory/2024-01-01.md", "memory/2099-01-01.md", "notes.md", "memory/2024-13-45.md", "2024-1-1.md", "2024-01-31.md"]
    p = spark.createDataFrame([(x,) for x in paths], "p string")
    assert [round(r[0], 9) for r in p.select(scores.decay(F.col("p"), F.to_date(F.lit("2024-01-31")), 30)).collect()] == [0.5, 1, 1, 1, 1, 1]
    with pytest.raises(ValueError):
        scores.decay(F.lit("x"), F.current_date(), 0)


def test_bm25_equals_sqlite(spark):
    texts = ["The quick brown fox", "Fox and fox, FÖX dog", "", "dog-fox foo_bar foo bar", "bar foo", "naïve café fox", "only dogs here", "foo x bar"] * 3
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, text)")
    db.executemany("insert into f values (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for query in ("fox", "fox fox", "foo_bar", "fox dog", "cafe", "__ fox", "missing fox"):
        tokens = [t for t in query.split()]
        want = dict(db.execute("select id, bm25(f) from f where f match ?", (" AND ".join(f'"{t}"' for t in tokens),)).fetchall())
        got = {r.id: r["rank"] for r in lexical.keyword_scores(spark.createDataFrame([(0, query)], "query_id long, query string"), docs).collect()}
        assert got.keys() == want.keys(), query
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got), query


def test_vectors_and_fusion(spark):
    rows = [(i, [math.cos(i / 5), math.sin(i / 5)] if i != 3 else None) for i in range(12)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    near = vector.vector_search(q, v, 4).orderBy("place").collect()
    assert [r.id for r in near] == [0, 1, 2, 4] and near[0].score == 1.0 and near[-1].score == 0.0
    one = vector.vector_search(q, v.where("id = 4"), 4).first()
    assert one.score == one.similarity
    assert vector.nearest(q.limit(0), v, 3).count() == 0
    vector.BROADCAST_QUERIES, before = 1, vector.BROADCAST_QUERIES
    try:
        assert [r.id for r in vector.nearest(q, v, 4).orderBy("place").collect()] == [0, 1, 2, 4]
    finally:
        vector.BROADCAST_QUERIES = before
    t = spark.createDataFrame([(7, 0, 0.5), (7, 9, 0.5)], "query_id long, id long, score double")
    fused = {r.id: r for r in hybrid.fuse(spark.createDataFrame([(7, 0, 1.0), (7, 5, 1.0)], t.schema), t, 10).collect()}
    assert round(fused[0].score, 9) == 0.85 and round(fused[5].score, 9) == 0.7 and round(fused[9].score, 9) == 0.15


def test_index_diff(spark):
    stored = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("z", "h")], "path string, hash string")
    disk = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("c", "h3")], "path string, hash string")
    assert index.counts(index.diff(stored, disk)).first().asDict() == {"indexed": 2, "skipped": 1, "deleted": 1}
    assert [r[0] for r in index.stale(stored, disk).collect()] == ["z"]
    assert sorted(r.path for r in index.prune(stored, disk).collect()) == ["a", "b"]


def test_workspace_from_end_to_end(spark, tmp_path):
    notes = tmp_path / "memory" / "sub dir"
    notes.mkdir(parents=True)
    (notes / "a.md").write_text("# Rust\nThe compiler is strict.\n## Setup\nInstall rustup first.\n")
    (tmp_path / "memory" / "2024-01-01.md").write_text("# Tea\nGreen tea is brewed at 80 degrees.\n")
    (tmp_path / "memory" / "skip.txt").write_text("# no")
    flags = ["--workspace", str(tmp_path), "--local-embed"]
    assert cli.main([*flags, "index"], spark) == ["indexed: 2  skipped: 0  deleted: 0"]
    assert cli.main([*flags, "index"], spark) == ["indexed: 0  skipped: 2  deleted: 0"]
    m = Memory(spark, config.Config(workspace=str(tmp_path)), HashModel())
    assert sorted(r.path for r in m.files().collect()) == ["memory/2024-01-01.md", "memory/sub dir/a.md"]
    before = {r.id for r in m.chunks().collect()}
    (notes / "a.md").write_text("# Rust\nThe compiler is kind.\n")
    (tmp_path / "memory" / "2024-01-01.md").unlink()
    assert m.index() == {"indexed": 1, "skipped": 0, "deleted": 1}
    after = m.chunks().collect()
    assert len(after) == 1 and after[0].id not in before and len(after[0].embedding) == 64
    lines = cli.main([*flags, "search", "kind compiler", "--lexical-only"], spark)
    assert len(lines) == 1 and lines[0].startswith("[1] score=0.") and "lex=" in lines[0] and "memory/sub dir/a.md:1-2" in lines[0]
    assert cli.main([*flags, "search", "absent", "--lexical-only"], spark) == ["no results"]
    row = m.search("kind compiler", 5).first()
    assert row.vector_score is not None and row.text_score is not None
    assert "Source: memory/sub dir/a.md (lines 1-2)\n# Rust\nThe compiler is kind.\n" in m.system_prompt("The compiler is kind. # Rust")
    (tmp_path / "context.md").write_text("  Be brief. \n")
    assert m.system_prompt("zzz qqq").startswith("Be brief.\n")
    m.insert_turn("s1", 0, "user", "hi")
    m.insert_turn("s1", 1, "assistant", "hello", "r1")
    m.insert_turn("s2", 0, "user", "again")
    assert m.history() == [("user", "hi"), ("assistant", "hello"), ("user", "again")] and m.last_response_id() == "r1"
    m.model.chat = lambda messages: "- likes tea"
    assert m.flush([{"role": "user", "content": "I like tea"}], datetime.date(2024, 5, 6)) == "- likes tea"
    assert (tmp_path / "memory" / "2024-05-06.md").read_text() == "- likes tea\n"
    m.model.chat = lambda messages: " @@SILENT@@ "
    assert m.flush([]) is None
    assert m.index(force=True)["indexed"] == 2 and m.last_response_id() == "r1"
    (tmp_path / "memory" / "new.md").write_text("# New\nfile\n")
    follow(m, str(tmp_path / "ck"), once=True).awaitTermination()
    assert m.files().count() == 3


def test_edits_and_deletions_alone_start_a_pass(spark, tmp_path):
    notes = tmp_path / "memory" / ".hidden"
    notes.mkdir(parents=True)
    (notes / "_a.md").write_text("# A\none\n")
    (notes / "b.md").write_text("# B\ntwo\n")
    m = Memory(spark, config.Config(workspace=str(tmp_path)), HashModel())
    passes, index_ = [], m.index
    m.index = lambda: passes.append(index_()) or passes[-1]

    def look():
        follow(m, str(tmp_path / "ck"), once=True).awaitTermination()
        return passes[-1]

    assert look() == {"indexed": 2, "skipped": 0, "deleted": 0}
    (notes / "_a.md").write_text("# A\nuno\n")
    assert look() == {"indexed": 1, "skipped": 1, "deleted": 0}
    (notes / "b.md").unlink()
    assert look() == {"indexed": 0, "skipped": 1, "deleted": 1}
    assert [r.text for r in m.chunks().collect()] == ["# A\nuno"]
    look()
    assert len(passes) == 3


def test_files_that_are_not_text_are_an_error(spark, tmp_path):
    from lanternbase.sources.markdown import scan

    (tmp_path / "memory").mkdir()
    (tmp_path / "memory" / "a.md").write_bytes(b"\xff\xfe")
    (tmp_path / "memory" / "dir.md").mkdir()
    assert scan(spark, str(tmp_path)).select("path").collect()[0].path == "memory/a.md"
    with pytest.raises(Exception, match="not UTF-8"):
        scan(spark, str(tmp_path)).collect()
    assert scan(spark, str(tmp_path), "absent").count() == 0


def test_missing_folder_prunes_nothing(spark, tmp_path):
    m = Memory(spark, config.Config(workspace=str(tmp_path)), HashModel())
    assert m.index() == {"indexed": 0, "skipped": 0, "deleted": 0} and (tmp_path / "memory").exists()
    assert m.search("x", 3).count() == 0 and m.search_keyword("x", 3).count() == 0


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('chat_model = "m"\nretrieval_limit = 9\nunknown = 1\n')
    c = config.load({"embed_model": "e", "chat_model": None}, str(path), {"HOME": str(tmp_path)})
    assert (c.chat_model, c.retrieval_limit, c.embed_model, c.base_url) == ("m", 9, "e", config.LOCAL_URL)
    c = config.load({"api_key": "flag"}, str(tmp_path / "none"), {"OPENAI_API_KEY": "k", "HOME": "/h"})
    assert (c.api_key, c.base_url, c.chat_model) == ("k", config.HOSTED_URL, config.HOSTED_CHAT)
    assert config.parse_env('# x\nexport A="1"\nB=\'2\'\n\nC') == {"A": "1", "B": "2"}
    with pytest.raises(ValueError):
        config.Config(decay_half_life_days=0)


def test_hosted_requests():
    m = HostedModel("http://x/v1/", "k", "chat", "emb")
    turns = [("user", "a"), ("assistant", "b")]
    full = conversation.messages("sys", turns, "q")
    assert m.request(full, None) == {"model": "chat", "store": False, "instructions": "sys", "input": full[1:]}
    assert m.request(full, "r1") == {"model": "chat", "store": True, "instructions": "sys", "previous_response_id": "r1", "input": "q"}
    with pytest.raises(NotImplementedError):
        HashModel().chat([])
    asked = []
    m._post = lambda path, body: asked.append((path, body)) or {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
    assert m.embed_many(["a", "b", "c"]) == [[1.0], [2.0], []] and asked == [("/embeddings", {"model": "emb", "input": ["a", "b", "c"]})]
    m._post = lambda path, body: {"id": "r", "output": [{"type": "message", "content": [{"type": "output_text", "text": "t"}]}]}
    assert list(m.chat_stream(full)) == ["t"]


class Picky(HashModel):
    def embed_many(self, texts):
        if "bad" in texts and len(texts) > 1:
            raise ValueError("one of the texts")
        return super().embed_many(texts)

    def embed(self, text):
        if text == "bad":
            raise ValueError(text)
        return super().embed(text)


def test_a_failed_embedding_costs_no_other(spark):
    from lanternbase.functions.models import embedding_column

    rows = spark.createDataFrame([(f"t{i}",) for i in range(150)] + [("bad",)], "t string").coalesce(1)
    got = {r.t: r.v for r in rows.select("t", embedding_column(Picky(8), rows.t).alias("v")).collect()}
    assert len(got) == 151 and [t for t, v in got.items() if v is None] == ["bad"]
    assert all(got[f"t{i}"] == pytest.approx(HashModel(8).embed(f"t{i}")) for i in range(150))


def test_chat_shows_its_turns_on_request(spark, tmp_path):
    from lanternbase.cli import chat

    (tmp_path / "memory").mkdir()
    (tmp_path / "memory" / "a.md").write_text("# Tea\ngreen tea\n")
    m = Memory(spark, config.Config(workspace=str(tmp_path), retrieval_threshold=0.0), HashModel())
    m.index()
    hosted = HostedModel("http://x", "k", "chat", "emb")
    hosted.respond = lambda messages, previous=None: ("it is " + messages[-1]["content"], "r9")
    said, noted, asked = [], [], iter(["green tea", " "])

    def ask(_):
        for line in asked:
            return line
        raise EOFError

    chat(m, hosted, ask, said.append, noted.append)
    assert said[-1] == "it is green tea" and m.history() == [("user", "green tea"), ("assistant", "it is green tea")] and m.last_response_id() == "r9"
    assert "1 chunks" in noted[0] and "memory/a.md:1-" in noted[1] and "green tea" in noted[2] and noted[-1].startswith("answer r9 of 4 words")


def test_result_lines(spark):
    rows = [(0, 1, 0.5, 0.25, None, "p.md", 1, 2, "x" * 300), (0, 2, 0.4, None, None, "q.md", 3, 4, " a\nb ")]
    df = spark.createDataFrame(rows, "query_id long, place int, score double, vector_score double, text_score double, path string, start_line int, end_line int, text string")
    a, b = [r.line for r in prompt.result_lines(df).orderBy("place").collect()]
    assert a == "[1] score=0.500  sem=0.250  p.md:1-2\n    " + "x" * 200 + "…\n" and b == "[2] score=0.400    q.md:3-4\n    a\n    b\n"


def test_snippets_are_measured_in_characters(spark):
    texts = ["ä" * 150, "ä" * 200, "ä" * 201, "  " + "ß" * 200 + "\n", "日本" * 101]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", prompt.snippet(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [texts[0], texts[1], "ä" * 200 + "…", "ß" * 200, "日本" * 100 + "…"]


def test_hidden_names_are_scanned_and_paths_are_relative(spark, tmp_path):
    from lanternbase.sources.markdown import scan

    workspace = tmp_path / "memory" / "x" / "memory"  # the workspace has its folder's name, twice
    names = ["a.md", "_b.md", ".c.md", "sub/d.md", "_priv/e.md", "with space+%20.md", "sub/.h/f.md"]
    for name in names:
        file = workspace / "memory" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"# {name}")
    (workspace / "memory" / "g.txt").write_text("no")
    got = {r.path: r for r in scan(spark, str(workspace)).collect()}
    assert sorted(got) == sorted(f"memory/{n}" for n in names)
    assert all(r.content == f"# {p.removeprefix('memory/')}" and r.size == len(r.content) and r.mtime > 1e9 for p, r in got.items())


def test_a_crash_leaves_the_last_complete_version(spark, tmp_path):
    from lanternbase.sources import snapshot

    root = str(tmp_path / "index")
    first = spark.range(3)
    snapshot.publish(spark, root, {"t": first})

    def fail(_):
        raise ValueError("widths")

    with pytest.raises(ValueError):
        snapshot.publish(spark, root, {"t": spark.range(5)}, fail)
    assert snapshot.read(spark, root, "t", "id long").count() == 3
    assert snapshot.publish(spark, root, {"t": spark.range(7)}).startswith("v000003")
    assert snapshot.read(spark, root, "t", "id long").count() == 7


def test_nearest_over_blocks_of_queries(spark, monkeypatch):
    from lanternbase.operators import vector

    rows = [(f"v{i}", [float(i), 0.0]) for i in range(6)] + [("none", None)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", [i + 0.4, 0.0]) for i in range(5)] + [("null", None)], "query_id string, vector array<double>")
    want = vector.nearest(queries, vectors, 2).collect()
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", 2)
    got = vector.nearest(queries, vectors, 2).collect()
    assert sorted(got) == sorted(want) and {(r.query_id, r.id) for r in got if r.place == 1} == {(f"q{i}", f"v{i}") for i in range(5)}
    with pytest.raises(Exception, match="components"):
        vector.nearest(queries, vectors.union(spark.createDataFrame([("w", [1.0])], vectors.schema)), 2).collect()
