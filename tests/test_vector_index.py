"""The clustered store against all pairs."""

import numpy as np
import pytest

from tarnmark.operators import vectors
from tarnmark.operators.vector_index import VectorIndex, fit_centroids


def brute(store, queries, k):
    ids = np.array([i for i, v in store if v is not None])
    x = np.array([v for _, v in store if v is not None])
    out = []
    for q, v in queries:
        if v is None:
            continue
        size = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
        sim = np.round(np.divide(x @ np.array(v), size, out=np.zeros(len(x)), where=size > 0), 12)
        for r, j in enumerate(np.lexsort((ids, -sim))[:k]):
            out.append((q, r + 1, int(ids[j]), round(float(sim[j]), 6)))
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.hit_rank, r.doc_id, round(r.similarity, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def store():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 16))
    own = [(i, (centres[rng.integers(0, 12) if i % 3 else 0] + rng.normal(0, 0.15, 16)).tolist()) for i in range(4000)]
    own += [(5000 + i, own[0][1]) for i in range(30)] + [(6000 + i, [0.0] * 16) for i in range(8)] + [(7000, None), (7001, (-centres[0]).tolist())]
    return own


@pytest.fixture(scope="module")
def index(spark, store):
    return VectorIndex.build(spark.createDataFrame(store, "doc_id long, embedding array<double>").repartition(4))


@pytest.mark.parametrize("k", [1, 5, 60])
def test_nearest_against_all_pairs(spark, store, index, k):
    queries = [(i, v) for i, v in store if i % 40 == 0] + [(9001, [0.0] * 16), (9002, None), (9003, (-np.array(store[0][1])).tolist()), (9004, [1.0] + [0.0] * 15)]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    assert rows(index.nearest(asked, k)) == brute(store, queries, k)
    assert 0 < index.share < (0.8 if k < 60 else 1)


def test_clusters_are_pruned(spark, store, index):
    asked = spark.createDataFrame([(i, v) for i, v in store[:400]], "query_id long, embedding array<double>")
    index.nearest(asked, 3).collect()
    assert index.share < 0.4


def test_text_ids_and_few_vectors(spark):
    store = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", [-1.0, 0.0])], "doc_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [3.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<float>")
    index = VectorIndex.build(store)
    got = index.nearest(asked, 10)
    assert rows(got) == rows(vectors.nearest(store, asked, 10))
    assert [r.doc_id for r in got.where("query_id = 'q'").orderBy("hit_rank").collect()] == ["a", "b", "c", "d"]
    index.delete()
    none = VectorIndex.build(store.limit(0))
    assert none.nearest(asked, 3).count() == 0 and none.share == 0
    with pytest.raises(ValueError):
        index.nearest(asked, 0)


def test_centroids_of_a_sample():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (500, 8))
    c = fit_centroids(np.vstack([x, np.zeros((5, 8))]), 7)
    assert c.shape == (7, 8) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert len(fit_centroids(np.zeros((3, 8)), 2)) == 0
