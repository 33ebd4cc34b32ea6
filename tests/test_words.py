"""Tokens by tables of bytes are those of the column expressions, and the index stores packed blocks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lanternbase.functions.text import document_tokens, trim
from lanternbase.functions.words import SPACE, are_plain, count_plain, plain, split_plain
from lanternbase.operators import postings
from lanternbase.operators.chunk import counted_chunks
from lanternbase.operators.segments import SegmentedIndex
from lanternbase.plans.catalogue import LETTERS, _letters


def test_every_plain_letter_folds_as_in_columns(spark):
    marks = [chr(c) for c in range(0x200)]
    texts = [*[m for m in marks], *[f"a{m}B" for m in marks], *[f"{m}{m} x{m}" for m in marks], "", "  ", "".join(marks), "Groß über ÉTÉ İstanbul naïve_ªº¼ x1y"]
    want = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(document_tokens(F.col("t")).alias("t")).collect()]
    held = pa.array(["é", *texts, "z"]).slice(1, len(texts))
    assert split_plain(held).to_pylist() == want and count_plain(held).tolist() == list(map(len, want)) and are_plain(held).all()


def test_other_texts_are_told_apart(spark):
    texts = ["plain é", "ǿ", "Ȁ", "Σίσυφος ΟΔΟΣ", "éte", "日本", "a\U0001f600b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.p for r in rows.select(plain(F.col("t")).alias("p")).collect()] == are_plain(pa.array(texts)).tolist() == [True, True, *[False] * 5]
    # a broken text is left to Spark, too
    assert [r.p for r in spark.sql("select cast(unhex(h) as string) t from values ('61C3'), ('C3'), ('6162') as v(h)").select(plain(F.col("t")).alias("p")).collect()] == [False, False, True]


def test_white_space_is_trimmed_as_in_columns(spark):
    marks = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000)]]
    got = spark.createDataFrame([(m,) for m in marks], "t string").where(trim(F.concat("t", F.lit("x"), "t")) == "x").collect()
    assert sorted(r.t for r in got) == sorted(SPACE)


def test_chunks_know_their_number_of_tokens(spark):
    contents = ["# A\r\nüber  \n# B\n\n日本 x ", " ", "plain\n#no\n", "Σας éte\n"]
    made = counted_chunks(spark.createDataFrame([(f"{i}.md", c) for i, c in enumerate(contents)], "path string, content string"))
    got = made.select("path", "text", "dl", F.size(document_tokens(F.col("text"))).alias("want")).orderBy("path", "start_line").collect()
    assert [r.text for r in got] == ["# A\nüber", "# B\n\n日本 x", "plain\n#no", "Σας éte"] and all(r.dl == r.want for r in got)


def test_blocks_are_stored_packed_and_hold_all_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "TEXTS", 300)
    rng = np.random.default_rng(5)
    words = np.array(["the", "été", "日本", "σας", *[f"w{i}" for i in range(40)]])
    texts = [" ".join(words[rng.integers(0, len(words), rng.integers(0, 30))]) for _ in range(300)]
    made = spark.createDataFrame([(f"{i:05d}", f"{i}.md", 1, 1, t) for i, t in enumerate(texts)], "id string, path string, start_line int, end_line int, text string").coalesce(1)
    index = SegmentedIndex(spark, str(tmp_path))
    index.apply(made.select("path", F.lit("h").alias("hash"), F.lit(0.0).alias("mtime"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("deleted")), made)
    stored = index._read(index.state(), "postings", postings.BLOCKS)
    # lists of lists took a record for each position when they were written
    assert not any("array" in kind for _, kind in spark.read.parquet(f"{tmp_path}/segments/{index.state()[0]['name']}/postings").dtypes)
    want = {(t, i): [p for p, x in enumerate(ts) if x == t] for i, ts in enumerate(r.t for r in made.orderBy("id").select(document_tokens(F.col("text")).alias("t")).collect()) for t in ts}
    lengths = {i: sum(len(p) for (_, d), p in want.items() if d == i) for i in range(300)}
    hits = postings._hits(stored, None, True).collect()
    assert {(r.term, r.doc_no): r.positions for r in hits} == want and len(hits) == len(want)
    assert all(r.tf == len(r.positions) and r.dl == lengths[r.doc_no] for r in hits)
    assert {(r.term, r.span): r.n for r in stored.groupBy("term", "span").agg(F.sum("n").alias("n")).collect()} == {k: sum((t, d >> 6) == k for t, d in want) for k in {(t, d >> 6) for t, d in want}}


def test_letters_are_counted_as_sql_counts_them(spark):
    texts = ["", "eaten", "Éta e\U0001f600", "x" * 1000 + "t", "eeee\n"]
    share = lambda c: (F.length("t") - F.length(F.replace(F.col("t"), F.lit(c), F.lit("")))) / F.greatest(F.length("t"), F.lit(1))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(_letters(F.col("t")).alias("got"), F.array(*[share(c).cast("float") for c in LETTERS]).alias("want")).collect()
    assert all(r.got == r.want for r in rows) and len(rows) == 5
