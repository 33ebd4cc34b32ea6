"""Sections of files read by splits against those of whole files."""

import io
import random

import pyarrow as pa
import pytest

from lanternbase.operators import splits
from lanternbase.operators.chunk import chunks
from lanternbase.operators.splits import file_chunks
from lanternbase.sources import tree
from lanternbase.sources.markdown import scan


@pytest.mark.parametrize("split", [64, 700, 10_000_000])
def test_same_sections_as_whole_files(spark, tmp_path, split):
    rng = random.Random(split)
    parts = ["# One", "## Two  ", "### Three", "#### no", "#bad", "", "   ", "text here", "a\ttab", "é" * 30, "# ", "##  x # y", "line\r", "```", "x" * 90]
    (tmp_path / "memory" / "sub").mkdir(parents=True)
    for i in range(12):
        text = "\n".join(rng.choice(parts) for _ in range(rng.randrange(0, 200))) + rng.choice(["", "\n", "\n\n"])
        (tmp_path / "memory" / ("sub" if i % 2 else ".") / f"f{i} %20.md").write_text(text, newline="")
    (tmp_path / "memory" / "plain.md").write_text("no header\n" * 300, newline="")
    (tmp_path / "memory" / "late.md").write_text("x\n" * 300 + "## B\ny\n# A\n" + "z\n" * 300 + "### C\nend", newline="")
    want = {tuple(r) for r in chunks(scan(spark, str(tmp_path)).select("path", "content")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = file_chunks(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(want) and {(r.id, r.path, r.start_line, r.end_line, r.context, r.text) for r in got} == want


@pytest.mark.parametrize("read", [1, 3, 1 << 20])
def test_each_line_is_in_one_split(read, monkeypatch):
    monkeypatch.setattr(splits, "READ", read)
    rng = random.Random(read)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n\r#") for _ in range(rng.randrange(40)))
        per = rng.choice([1, 2, 5, 9, 100])
        got = [x for b in range(0, len(data), per) for some in splits._lines(io.BytesIO(data), b, min(b + per, len(data))) for x in some]
        want = data.decode().split("\n")
        assert got == [x.removesuffix("\r") for x in (want[:-1] if want[-1] == "" else want)], (data, per)


def test_files_are_read_once_and_not_as_rows_of_lines(spark, tmp_path):
    (tmp_path / "memory").mkdir()
    for i in range(40):
        (tmp_path / "memory" / f"{i}.md").write_text("# A\n" + "x\n" * 50)
    (tmp_path / "memory" / "_hidden.md").write_text("x")
    got = file_chunks(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the pieces are a table: files that are small take no scan of their own, and nothing reads them three times
    assert "FileScan text" not in plan and "MapInArrow" not in plan
    assert got.count() == 40


def test_a_folder_is_listed_entry_by_entry(tmp_path, monkeypatch):
    for i in range(9):
        where = tmp_path / ("a" if i % 2 else ".b/_c")
        where.mkdir(parents=True, exist_ok=True)
        (where / f"{i}.md").write_text("x" * i)
    (tmp_path / "a" / "no.txt").write_text("")
    monkeypatch.setattr(tree, "NAMES", 2)
    batches = list(tree._list(tmp_path.as_uri())(iter([pa.record_batch([pa.array([0])], names=["id"])])))
    assert [b.num_rows for b in batches] == [2, 2, 2, 2, 1]
    assert sorted((p.rsplit("/", 1)[1], n) for b in batches for p, n in zip(b["path"].to_pylist(), b["size"].to_pylist(), strict=True)) == [(f"{i}.md", i) for i in range(9)]
    assert list(tree.listed((tmp_path / "none").as_uri())) == []
