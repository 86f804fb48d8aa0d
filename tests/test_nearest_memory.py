"""What a task of the nearest vectors holds."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tarnmark.operators.vectors import _matrix, _own_best


class Shipped:
    def __init__(self, value):
        self.value = value


def test_a_batch_is_multiplied_in_slices():
    rng = np.random.default_rng(5)
    x, q = np.round(rng.normal(size=(9000, 8)), 1), np.round(rng.normal(size=(700, 8)), 1)
    x[4000:4100] = x[:100]  # ties
    shipped = Shipped((list(range(700)), q, np.linalg.norm(q, axis=1), (pa.int64(), pa.int64(), pa.float64(), pa.float64())))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 8, dtype=np.int32)), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(9000)), vectors], names=["doc_id", "embedding"])
    tracemalloc.start()
    out = pa.Table.from_batches(list(_own_best(shipped, 4)([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9000 * 700 * 8  # one matrix of all pairs of the batch
    near = np.round(x @ q.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)), 12)
    wanted = [sorted(zip((-near[:, c]).tolist(), range(9000)))[:4] for c in range(700)]
    got = [[] for _ in wanted]
    for r in out.to_pylist():
        got[r["query_id"]].append(r["doc_id"])
    assert got == [[i for _, i in w] for w in wanted]


def test_vectors_of_one_length_only():
    assert _matrix(pa.array([[1.0, 2.0], [3.0, None]], pa.list_(pa.float64())))[0].tolist() == [1, 2]
    with pytest.raises(ValueError):
        _matrix(pa.array([[1.0], [2.0, 3.0, 4.0]], pa.list_(pa.float64())))
