"""Every operator and pipeline stage on odd tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternbase.llm.alignment import alignment
from lanternbase.llm.hilbert_knn import neighbours
from lanternbase.llm.image_copies import image_copies, write_pgm
from lanternbase.llm.mixing import mix
from lanternbase.llm.near_copies import deduplicate as near_deduplicate
from lanternbase.llm.ngram_lm import cross_entropy_difference
from lanternbase.llm.packing import pack
from lanternbase.llm.quality import accepted, fit, score, statistics
from lanternbase.llm.rlz_dedup import cut_spans, remove_spans
from lanternbase.llm.segment_sampling import decode_segmentations, sample_segmentations
from lanternbase.llm.simhash import deduplicate, simhash_groups
from lanternbase.llm.spelling import spelling_variants
from lanternbase.llm.suffix_dedup import remove_repeats
from lanternbase.llm.wordpiece_counts import piece_counts

SCHEMA = "doc_id long, text string, TEXT string, Doc_ID long, n_chars long, sample int, part int"


def model():
    rng = random.Random(3)
    texts = [("fine words here " * rng.randrange(3, 9)).encode() for _ in range(40)] + [b"$$$ " * rng.randrange(3, 9) for _ in range(40)]
    return fit(statistics(texts), np.array([1.0] * 40 + [0.0] * 40))


def odd_rows():
    long = " ".join(random.Random(1).choice("abcdefgh") * random.Random(i).randrange(1, 9) + str(i % 997) for i in range(150_000))
    texts = ["one two three", None, "", "   ", long, "x" * 200_000, "same text here " * 40, "same text here " * 40, "é🙂 ﬀ"]
    rows = [(i, t, "other", 7, len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, "one two three", None, None, None, None, None)]


#: name, call, rows of the result for each row of the input (None: any number)
CALLS = {
    "score": (lambda df: score(df, model()), 1),
    "accepted": (lambda df: accepted(df, model()), None),
    "simhash_groups": (simhash_groups, 1),
    "deduplicate": (deduplicate, None),
    "near_deduplicate": (near_deduplicate, None),
    "remove_repeats": (remove_repeats, 1),
    "remove_spans": (remove_spans, 1),
    "cut_spans": (cut_spans, 1),
    "pack": (pack, None),
    "piece_counts": (piece_counts, 1),
    "lm": (lambda df: cross_entropy_difference(df, df.select("doc_id").where("doc_id < 3")), 1),
    "sample_segmentations": (lambda df: decode_segmentations(sample_segmentations(df, ["doc_id"], k=2)), None),
    "spelling_variants": (lambda df: spelling_variants(df, wear=3), None),
    "alignment": (alignment, 1),
    "mix": (lambda df: mix(df, F.array(F.lit(None).cast("string"), F.lit("a")))[0], 1),
}
KEEPS = ("accepted", "deduplicate", "near_deduplicate", "cut_spans")


@pytest.fixture(scope="module")
def case_sensitive(spark):
    """Only with this can a test make and read a table with such names."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    frame.count()
    spark.conf.set("spark.sql.caseSensitive", "false")
    return frame


@pytest.mark.parametrize("name", CALLS)
def test_odd_rows(spark, case_sensitive, name):
    call, each = CALLS[name]
    named = call(case_sensitive) if name != "lm" else cross_entropy_difference(case_sensitive, spark.createDataFrame([(0,), (None,), (0,), (99,)], "doc_id long"))
    got = named.toDF(*[f"c{i}" for i in range(len(named.columns))]).collect()
    if each:
        assert len(got) == len(odd_rows())
    if name in KEEPS:
        assert named.columns == case_sensitive.columns and all(r.c2 in ("other", None) for r in got)
    if name in ("deduplicate", "near_deduplicate"):
        assert {r.c0 for r in got} >= {None, 0, 1} and 7 not in {r.c0 for r in got} and sum(r.c0 == 0 for r in got) == 3
    if name == "cut_spans":
        by = {r.c0: r.c1 for r in got}
        assert by[1] is None and by[6] and by[7] == "" and by[4] == odd_rows()[4][1] and by[5] == odd_rows()[5][1]


@pytest.mark.parametrize("name", [n for n in CALLS if n != "lm"])
def test_empty_tables(spark, name):
    assert CALLS[name][0](spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_segmentations_decode_to_null(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode_segmentations(df).collect()} == {1: None, 2: ""}


def test_odd_vectors_and_images(spark):
    rows = [(20, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (None, [1.0, 1.0])]
    got = neighbours(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 5, 1.0), (20, 2, 6, 1.0)]
    large = write_pgm(np.random.default_rng(0).uniform(0, 255, (600, 700)))
    images = [(1, large, 0), (1, large, 0), (2, large, 0), (3, None, 0), (4, b"P5", 0), (None, large, 0)]
    got = {r.id: r for r in image_copies(spark.createDataFrame(images, "id long, image binary, key int")).collect()}
    assert {i: r.class_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1].n_features > 1000
