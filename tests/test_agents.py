"""Objects over a loaded bundle: retrievers, router, navigator."""

import pytest
from pyspark.sql import functions as F

from tarnmark.operators import sync
from tarnmark.plans.agents import GraphRetriever, LexicalRetriever, Navigator, Router
from tarnmark.plans.bundle import Bundle
from tests.test_navigation import model

NOTES = {"a": ("Alder", "see [b](b.md), bark"), "b": ("Birch", "see [c](c.md), bark"), "c": ("Cedar", "bark and cone")}


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(i, f"/{i}.md", f"---\ntype: tree\ntitle: {t}\n---\n{body}") for i, (t, body) in NOTES.items()]
    return Bundle.of_notes(spark.createDataFrame(rows, "id string, path string, raw string"), "/wood")


def found(rows):
    return [r.concept_id for r in rows.orderBy("query_id", "rank").collect()]


def test_lexical_retriever(spark, trees):
    asked = spark.createDataFrame([(1, "bark")], "query_id long, query string")
    retriever = LexicalRetriever(trees, top_k=2)
    assert found(retriever.retrieve(asked)) == ["a", "b"]
    assert found(retriever.retrieve(asked, top_k=1)) == ["a"] and found(retriever.retrieve(asked, top_k=9)) == ["a", "b", "c"]
    for k in (0, -1):
        with pytest.raises(ValueError):
            retriever.retrieve(asked, top_k=k)


def test_graph_retriever(spark, trees):
    asked, wanted = spark.createDataFrame([(1, "x")], "query_id long, query string"), []

    def store(queries, k):
        wanted.append(k)
        hits = [(0, "b", None), (1, "a", "/other"), (2, "zz", "/wood"), (3, "a", "/wood"), (4, "b", None)]
        hits = spark.createDataFrame(hits, "hit_rank int, concept_id string, bundle_root string")
        return queries.select("query_id").crossJoin(hits).where(F.col("hit_rank") < k)

    retriever = GraphRetriever(trees, store, top_k=5, expand_hops=2)
    assert found(retriever.retrieve(asked)) == ["b", "a", "c"]
    assert found(retriever.retrieve(asked, top_k=1)) == ["b", "c"]
    assert found(GraphRetriever(trees, store, expand_hops=0).retrieve(asked)) == ["b", "a"]
    assert found(GraphRetriever(trees, store, 1, direction="in").retrieve(asked)) == ["b", "a"]
    assert wanted == [5, 1, 5, 1]


def test_settings_are_checked_first(spark, trees):
    nothing = lambda *_: None
    for make in (LexicalRetriever, Router, lambda b: GraphRetriever(b, nothing), lambda b: Navigator(b, nothing)):
        with pytest.raises(TypeError, match="str"):
            make("no bundle")
    for make in (lambda: GraphRetriever(trees, 5), lambda: Navigator(trees, 5), lambda: Router(trees, classifier=5)):
        with pytest.raises(TypeError, match="int"):
            make()
    for make in (
        lambda: LexicalRetriever(trees, 0), lambda: GraphRetriever(trees, nothing, 0), lambda: GraphRetriever(trees, nothing, expand_hops=-1),
        lambda: GraphRetriever(trees, nothing, direction="up"), lambda: Navigator(trees, nothing, max_hops=-1), lambda: Navigator(trees, nothing, token_budget=1),
        lambda: Navigator(trees, nothing, strategy="x"),
    ):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError, match="lookup"):
        sync.sync_external(sync.prepared(trees.concepts, "/wood"), None, nothing)
    with pytest.raises(TypeError, match="write"):
        sync.sync_external(sync.prepared(trees.concepts, "/wood"), nothing, None)


def test_router_and_navigator(spark, trees):
    asked = spark.createDataFrame([("1", "alder"), ("2", "what else?")], "question_id string, query string")
    assert {r.question_id: r.route for r in Router(trees, has_store=True).route(asked).collect()} == {"1": "bundle", "2": "vector"}
    navigator = Navigator(trees, model('["a"]', '{"sufficient": false, "next_concept_ids": ["b"]}'), max_hops=2, token_estimator=len, token_budget=400)
    r = navigator.ask(spark.createDataFrame([("1", "which?")], "question_id string, question string")).first()
    assert (r.visited, r.citations, r.degraded) == (["a", "b"], ["a"], False)
