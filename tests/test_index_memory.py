"""Memory of the tasks that make postings follows small steps, not whole slices or batches."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lanternbase.operators import postings


def _peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_numbers_become_bytes_a_few_at_a_time():
    values = np.random.default_rng(7).integers(0, 1 << 20, 2_000_000)
    assert _peak(lambda: postings._to_bytes(values)) < 24  # 6 MB of bytes, twice while they are joined, and 2 MB of lengths


def test_bytes_of_few_and_many_numbers_are_read_back():
    for n in (0, 1, postings.WRITTEN - 1, postings.WRITTEN, 2 * postings.WRITTEN + 3):
        values = np.random.default_rng(n).integers(0, 1 << 35, n) >> np.random.default_rng(n + 1).integers(0, 35, n)
        data, many = postings._to_bytes(values)
        assert len(many) == n and many.sum() == len(data)
        assert (postings._from_bytes(data)[0] == values).all()


def test_packed_rows_become_blocks_a_few_at_a_time():
    rng, docs, each = np.random.default_rng(3), 2000, 500
    words = np.array([f"w{i}" for i in range(50_000)])[rng.zipf(1.3, docs * each) % 50_000]
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * each), pa.array(words))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(docs)), tokens], names=["doc_no", "tokens"])
    rows = pa.Table.from_batches(list(postings._pack(iter([batch])))).combine_chunks().to_batches()[0]
    found = 0

    def run() -> None:
        nonlocal found
        for made in postings._unpack(iter([rows])):
            found += sum(map(sum, made.column("tfs").to_pylist()))

    assert _peak(run) < 40
    assert found == docs * each
