"""Indexed search against a full scan."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tarnmark.operators import search, search_index
from tarnmark.operators.search_index import SearchIndex

FIELDS = "id string, title string, tags array<string>, description string, body string"


@pytest.fixture(scope="module")
def concepts(spark):
    rng = random.Random(8)
    parts = ["an", "the", "orders", "straße", "STRASSE", "ﬁn", "Ünï", "數據", "x", "refund", "fund", "ref", "und"]
    say = lambda n: "".join(rng.choice(parts) + rng.choice(["", " ", "-", "_"]) for _ in range(n))
    rows = [(f"n/{i:03}", say(2), [say(1), say(1)] if i % 3 else None, say(4) if i % 4 else None, say(30)) for i in range(300)]
    rows += [("n/empty", None, [], None, None), ("n/same", "t", ["a"], None, "same"), ("n/same", "t", ["a"], None, "same"), ("n/long", "long", None, None, "refund " * 50_000)]
    return spark.createDataFrame(rows, FIELDS).repartition(5)


@pytest.fixture(scope="module")
def index(concepts):
    return SearchIndex.build(concepts)


ASKED = ["the refund", "orders orders strasse", "Ünï", "數據", "數", "refundfund", "x", "nothinghere", "", "- !", "ﬁn fin", "an the ref und fund", "same", "ref_und refund straße"]


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("top_k", [1, 5, 40, 1000])
def test_index_finds_what_a_scan_finds(spark, concepts, index, top_k):
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    want = rows(search.search(concepts, queries, top_k))
    assert rows(index.search(queries, top_k)) == want and len(want) > 10


def test_one_query_and_other_keys(spark, concepts, index):
    want = [tuple(r) for r in search.search_one(concepts, "refund the x", 7).orderBy("rank").collect()]
    again = SearchIndex.open(spark, index.path)
    assert [(r["rank"], r.id, r.score) for r in again.search_one("refund the x", 7).orderBy("rank").collect()] == want
    queries = spark.createDataFrame([("a", "refund"), (None, "the"), ("b", None)], "query_id string, query string").where("query_id is not null")
    assert {r.query_id for r in again.search(queries, 3).collect()} == {"a"}
    with pytest.raises(ValueError):
        index.search(queries, 0)
    assert index.search(queries.limit(0), 3).count() == 0


def test_few_bodies_are_read(spark, index, monkeypatch):
    """Only candidates are scored, and only their blocks are scanned."""
    index.pairs = 0
    index.search_one("refundfund orders", 3).collect()
    assert 0 < index.pairs < 150
    seen = []
    scored = SearchIndex._scored
    monkeypatch.setattr(SearchIndex, "_scored", lambda self, *a: seen.append(scored(self, *a)) or seen[-1])
    index.search_one("refundfund", 3).collect()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_index_of_nothing(spark, concepts):
    index = SearchIndex.build(concepts.limit(0))
    assert index.search_one("the", 3).count() == 0
    index.delete()


def test_bundle_searches_by_its_index(spark, tmp_path):
    from tarnmark.plans.agents import LexicalRetriever
    from tarnmark.plans.bundle import Bundle

    for name, body in (("one", "refund policy"), ("two", "refund refund"), ("three", "else")):
        (tmp_path / f"{name}.md").write_text(f"---\ntype: note\ntitle: {name}\n---\n{body}\n")
    bundle = Bundle.load(spark, str(tmp_path))
    scan = bundle.search("refund policy").collect()
    asked = spark.createDataFrame([(1, "refund policy"), (2, "else")], "query_id int, query string")
    found = LexicalRetriever(bundle, 2).retrieve(asked).orderBy("query_id", "rank").collect()
    bundle.build_search_index()
    assert bundle.search("refund policy").collect() == scan
    assert LexicalRetriever(bundle, 2).retrieve(asked).orderBy("query_id", "rank").collect() == found


def test_grams():
    assert set(search_index.grams("abc")) == {x for t in ("a", "b", "c", "ab", "bc", "abc") for x in search_index.token_grams(t)}
    assert len(search_index.grams("")) == 0 and len(search_index.token_grams("abcd")) == 2
    long = "abcdefghij" * 150_000
    assert len(search_index.grams(long)) == 30
    assert search_index.grams("\U0010ffff" * 4).max() < 1 << 63


def test_postings_in_lots(monkeypatch):
    monkeypatch.setattr(search_index, "LOT_ENTRIES", 60)
    docs = [*range(search_index.BLOCK - 20, search_index.BLOCK + 20)]
    given = pa.RecordBatch.from_pylist([{"doc": d, "title": f"t{d % 7}", "tags": ["a", "b"], "description": "", "body": "word"} for d in docs])
    found = [r for b in search_index._postings(iter([given])) for r in b.to_pylist()]
    word = search_index.token_grams("wor")[0]
    held = [r["lot"] + p for r in found if r["gram"] == word and r["field"] == 3 for p in np.flatnonzero(search_index.unpack(r["docs"], r["size"]))]
    assert sorted(held) == docs and len({r["lot"] for r in found}) > 5
    assert all(r["lot"] // search_index.BLOCK == (r["lot"] + r["size"] - 1) // search_index.BLOCK for r in found)


def test_packed_places():
    rng = np.random.default_rng(1)
    for n in (0, 1, search_index.DENSE - 1, search_index.DENSE, search_index.BLOCK):
        places = np.sort(rng.choice(search_index.BLOCK, n, replace=False))
        assert (np.flatnonzero(search_index.unpack(search_index.pack(places))) == places).all()
        assert len(search_index.pack(places)) <= search_index.BLOCK // 8


class Shipped:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("top_k", [1, 3])
def test_a_scoring_task_keeps_its_own_best_of_what_was_asked(top_k):
    """Candidates are as many as pairs, rows that leave a task are not; a tag may be null."""
    rng = random.Random(top_k)
    text = lambda n: "".join(rng.choice(["ab", "b", "ba", "é", "-", " ", " "]) for _ in range(n))
    blocks = {(0, 0): (["a", "ba"], [("p", [0, 0, 1]), ("q", [1])]), (0, 1): (["b", "é", "abba"], [("r", [0, 1, 2])])}
    rows = [{"doc": d, "id": f"d{d}", "title": text(2), "tags": [text(2), None], "description": "", "body": text(9), "queries": rng.sample("pqr", rng.randrange(1, 4))} for d in range(400)]
    batch = pa.RecordBatch.from_pylist(rows)
    got = [tuple(r.values()) for b in search_index._exact(Shipped(blocks), top_k)(iter([batch.slice(0, 150), batch.slice(150)])) for r in b.to_pylist()]
    wanted = []
    for terms, asked in blocks.values():
        for query, at in asked:
            score = lambda r: sum(4 * (t in r["title"]) + 3 * (t in r["tags"][0]) + (t in r["body"]) for t in (terms[i] for i in at))  # noqa: B023, E731
            found = sorted((-score(r), r["doc"]) for r in rows if query in r["queries"] and score(r))
            wanted += [(query, d, f"d{d}", -s) for s, d in found[:top_k]]
    assert sorted(got) == sorted(wanted) and len(got) == 3 * top_k
