"""Exact neighbours by pivots against the scan of all vectors."""

import numpy as np
import pytest

from lanternbase.operators import pivots, vector
from lanternbase.operators.pivots import PivotIndex


def table(spark, x):
    return spark.createDataFrame([(f"v{i:05d}", None if i % 97 == 5 else list(map(float, v))) for i, v in enumerate(x)], "id string, embedding array<double>")


def rows(df):
    return sorted((r.query_id, r.place, r.id, r.distance) for r in df.collect())


@pytest.mark.parametrize("kind", ["clustered", "random", "equal", "few"])
def test_same_rows_as_a_scan(spark, tmp_path, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = {
        "clustered": lambda: rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] * 20 + rng.normal(size=(4000, 8)),
        "random": lambda: rng.normal(size=(1500, 16)),
        "equal": lambda: np.ones((1500, 4)) * (rng.integers(0, 3, 1500) // 2)[:, None],
        "few": lambda: rng.normal(size=(4, 4)),
    }[kind]()
    monkeypatch.setattr(pivots, "CELL", 30)
    vectors = table(spark, x)
    index = PivotIndex(spark, str(tmp_path / "p"))
    index.write(vectors)
    queries = spark.createDataFrame([(i, list(map(float, x[i] + (0.1 if i % 2 else 0)))) for i in range(0, len(x), max(1, len(x) // 20))] + [(-1, None)], "query_id long, vector array<double>")
    want = rows(vector.nearest(queries, vectors, 7))
    got, told = index.nearest_counting(queries, 7)
    assert rows(got) == want and told["rows"] == sum(i % 97 != 5 for i in range(len(x)))
    if kind == "clustered":
        # one query looks at its own cluster only
        one, told = index.nearest_counting(queries.where("query_id = 0"), 7)
        assert rows(one) == [r for r in want if r[0] == 0] and told["first"] + told["second"] < told["rows"] / 5
        monkeypatch.setattr(pivots, "QUERIES", 6)
        assert rows(index.nearest(queries, 7)) == want
    with pytest.raises(ValueError):
        index.nearest(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3)
    assert index.nearest(queries.limit(0), 3).count() == 0


def test_ties_leave_a_batch_as_k_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5000)], "id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0])], "query_id long, vector array<double>")
    got = vector.nearest(queries, same, 3)
    assert sorted((r.query_id, r.place, r.id) for r in got.collect()) == [(q, i + 1, i) for q in (0, 1) for i in range(3)]
    import pyarrow as pa

    row, col, far = vector.chosen(np.repeat([0, 1], 5), np.tile(np.arange(5), 2), np.zeros(10), pa.array(["e", "d", "c", "b", "a"]), 2)
    assert row.tolist() == [0, 0, 1, 1] and col.tolist() == [4, 3, 4, 3] and len(far) == 4
