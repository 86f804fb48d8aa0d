"""The scan of a search: what leaves a task, and scores against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tarnmark.operators import search
from tarnmark.operators.search import _best, _Terms


class Shipped:
    def __init__(self, value):
        self.value = value


def test_terms_within_words():
    find = _Terms(["a", "ab", "abc", "bca", "x", "abcab"])
    lists = pa.array([["abcab", "zz"], None, [], ["xx", "ab"]], pa.list_(pa.string()))
    got = sorted(set(zip(*(x.tolist() for x in find.of(lists)))))
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 5), (3, 0), (3, 1), (3, 4)]
    assert [len(x) for x in find.of(lists.slice(1, 2))] == [0, 0]


def test_a_task_keeps_its_own_best():
    n = 3000  # more rows than a slice, all of one score
    none, words = pa.array([[]] * n, pa.list_(pa.string())), pa.array([["word"]] * n, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i:05}" for i in reversed(range(n))]), none, none, none, words], names=["id", "title", "tags", "description", "body"])
    shipped = Shipped((["or"], [(np.array([0]), [(7, np.array([0, 0])), (8, np.array([0]))])], pa.int64()))
    out = pa.Table.from_batches(list(_best(shipped, 3)([batch.slice(0, 1700), batch.slice(1700)]))).to_pylist()
    assert [(r["query_id"], r["id"], r["score"]) for r in out] == [(q, f"d{i:05}", s) for q, s in ((7, 2), (8, 1)) for i in range(3)]


@pytest.mark.parametrize("top_k", [1, 4, 50])
def test_search_is_the_plain_loop(spark, monkeypatch, top_k):
    rng = random.Random(top_k)
    word = lambda: "".join(rng.choice("abß_é1") for _ in range(rng.randrange(1, 6)))
    text = lambda n: rng.choice([" ", "-"]).join(word() for _ in range(rng.randrange(n)))
    notes = [(f"n{i}", text(3), [text(2), None, text(3)] if i % 7 else None, None if i % 3 else text(4), text(9)) for i in range(150)]
    asked = [(q, text(6)) for q in range(40)] + [(40, ""), (41, None), (3, "a b")]
    concepts = spark.createDataFrame(notes, "id string, title string, tags array<string>, description string, body string").repartition(3)
    monkeypatch.setattr(search, "PASS_BYTES", 300)
    monkeypatch.setattr(search, "BLOCK", 4)
    got = search.search(concepts, spark.createDataFrame(asked, "query_id int, query string"), top_k).collect()
    scores: dict = {}
    for q, query in asked:
        for i, title, tags, description, body in notes:
            fields = [(4, [title]), (3, tags or []), (2, [description]), (1, [body])]
            tokens = "".join(c if c.isalnum() or c == "_" else " " for c in (query or "").casefold()).split()
            scores.setdefault(q, []).append((-sum(w * any(t in (g or "").casefold() for g in f) for t in tokens for w, f in fields), i))
    wanted = [(q, r, i, -s) for q, found in scores.items() for r, (s, i) in enumerate([x for x in sorted(found) if x[0]][:top_k], 1)]
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_long_words_are_not_remembered():
    find = _Terms(["ab", "abc"])
    assert sorted(find.within("abc" * 40)) == [0, 1]
    assert sorted(find.within("xab")) == [0] and list(find.known) == ["xab"]
