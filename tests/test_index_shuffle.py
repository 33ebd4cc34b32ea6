"""What building an index shuffles, and how much a task holds of it."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lanternbase.operators import postings, segments
from lanternbase.operators.chunk import chunks
from lanternbase.operators.segments import SegmentedIndex


def test_sections_are_cut_without_a_shuffle(spark):
    rows = [("a.md", "pre\r\n# T  \r\nx\n### S\n\n## U\n\r"), ("b.md", ""), ("c.md", None), ("d.md", "\n\n# A")]
    got = chunks(spark.createDataFrame(rows, "path string, content string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.start_line, r.end_line, r.context, r.text) for r in got.collect()) == [
        ("a.md", 1, 1, "", "pre"), ("a.md", 2, 3, "T", "# T  \nx"), ("a.md", 4, 5, "T > S", "### S"), ("a.md", 6, 7, "T > U", "## U"), ("d.md", 3, 3, "A", "# A"),
    ]


def test_postings_are_shuffled_as_a_row_for_a_term_and_slice(monkeypatch):
    rng = np.random.default_rng(4)
    words = np.array(["the", "a", *[f"w{i}" for i in range(300)]])
    texts = [["the", *words[rng.integers(0, len(words), rng.integers(0, 40))]] for _ in range(500)]
    texts[7] = []
    # numbers of two files, as a task may read several
    doc = np.append(np.arange(300), (1 << 33) + np.arange(200))
    batch = pa.record_batch([pa.array(doc), pa.array(texts, pa.list_(pa.string()))], names=["doc_no", "tokens"])
    want = {(t, int(d)): [i for i, x in enumerate(ts) if x == t] for d, ts in zip(doc, texts, strict=True) for t in ts}
    for size in (1 << 18, 700):
        monkeypatch.setattr(postings, "SLICE", size)
        monkeypatch.setattr(postings, "UNPACKED", 4000)
        packed = list(postings._pack(iter([batch])))
        # a slice is bounded, and a frequent term is one row of it for each file, not one for each span
        assert (len(packed) == 1) == (size == 1 << 18) and all(sum(pc.equal(p["term"], "the").to_pylist()) <= 2 for p in packed)
        got, spans = {}, 0
        for b in postings._unpack(iter(packed)):
            for r in b.to_pylist():
                spans += 1
                assert r["n"] == len(r["docs"]) and {d >> postings.SPAN_BITS for d in r["docs"]} == {r["span"]}
                for d, tf, dl, pos in zip(r["docs"], r["tfs"], r["dls"], r["positions"], strict=True):
                    assert tf == len(pos) and dl == len(texts[int(np.flatnonzero(doc == d)[0])])
                    got[r["term"], d] = pos
        assert got == want and spans > sum(map(len, packed))


def test_texts_are_stored_once_and_never_shuffled_for_vectors(spark, tmp_path, monkeypatch):
    embed = lambda c: F.array(F.length(c).cast("float"), F.lit(1).cast("float"))
    contents = {f"{i}.md": f"# T{i % 7}\ncommon text {i % 40}\n" for i in range(60)}
    files = lambda held: spark.createDataFrame([(p, c, 0.0, len(c)) for p, c in held.items()], "path string, content string, mtime double, size long")
    kept = []
    keep = SegmentedIndex._keep
    monkeypatch.setattr(SegmentedIndex, "_keep", lambda self, df: kept.append(df.columns) or keep(self, df))
    later = {p: c + ("more\n" if p < "3" else "") for p, c in contents.items() if p != "7.md"}
    for few in (1 << 18, 10, 0):
        # sent to all tasks, left out by all tasks, and shuffled
        monkeypatch.setattr(segments, "FEW", few)
        made = SegmentedIndex(spark, str(tmp_path / str(few)))
        for held in (contents, later, later):
            made.update(files(held), "m", embed)
        for _ in range(2):
            made.update(files(later), "m", lambda c: F.raise_error(F.concat(F.lit("asked again: "), c)).cast("array<float>"), force=True)
        rows = made.chunks().collect()
        want = {p: float(len(c.split("\n")[0][2:] + "\n\n" + c.strip())) for p, c in later.items()}
        assert {r.path: r.embedding[0] for r in rows} == want and {r.id: r.embedding for r in rows} == {r.id: r.embedding for r in made.embedded().collect()}
        assert made.stats() == (59, sum(len(c.replace("#", "").split()) for c in later.values()) / 59)
    assert kept and not any({"text", "content", "input"} & set(columns) for columns in kept)
    plan = made.embedded()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_postings_are_shuffled_in_few_bytes():
    values = np.append(np.arange(300), [16383, 16384, 2097151, 2097152, (1 << 28) - 1, 1 << 28, (1 << 31) - 1])
    data, many = postings._to_bytes(values)
    back, ends = postings._from_bytes(data)
    assert back.tolist() == values.tolist() and ends.tolist() == np.cumsum(many).tolist() and many[[127, 128]].tolist() == [1, 2] and many.max() == 5
    docs, tokens = pa.array(range(1000)), pa.array([["a", "b"] * 20] * 1000, pa.list_(pa.string()))
    rows = list(postings._pack(iter([pa.record_batch([docs, tokens], names=["doc_no", "tokens"])])))
    # a number, a count, a length and twenty positions of two terms in a thousand documents: 184,000 bytes with 32 bits each
    assert sum(pc.sum(pc.binary_length(r["packed"])).as_py() for r in rows) == 2 * 1000 * 23
