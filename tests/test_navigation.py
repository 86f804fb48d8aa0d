"""Bounded reading with a scripted model."""

import json

import pytest

from tarnmark.functions.payload import json_payload, read_answer, read_decision, read_plan, response_text
from tarnmark.operators.navigation import ASKED, explore, index_token_cost, navigate
from tarnmark.plans.bundle import Bundle

INDEX = "# I\n"


def bundle(spark, links):
    rows = [(i, f"/{i}.md", "---\ntype: t\n---\n" + " ".join(f"[{x}]({x}.md)" for x in out)) for i, out in links.items()]
    return Bundle.of_notes(spark.createDataFrame(rows, "id string, path string, raw string"), "/")


@pytest.fixture(scope="module")
def chain(spark):
    return bundle(spark, {"a": "b", "b": "ca", "c": "d", "d": ""})


@pytest.fixture(scope="module")
def star(spark):
    return bundle(spark, {"a": "dcb", "b": "", "c": "", "d": ""})


def model(plan, decide=None, answer='{"answer": "yes", "citations": ["a", "zz", "a"]}'):
    def say(messages):
        return {ASKED["plan"]: plan, ASKED["decide"]: decide, ASKED["generate"]: answer}[messages[0][1]]

    return say


def run(spark, b, say, **bounds):
    asked = spark.createDataFrame([("1", "why?")], "question_id string, question string")
    return navigate(asked, b.concepts, b.edges, INDEX, say, **bounds).first()


def test_progressive(spark, chain, star):
    r = run(spark, chain, model('{"concept_ids": ["a", "zz", "a"]}', '{"sufficient": false, "next_concept_ids": ["b"]}'))
    assert (r.visited, r.hops, r.answer, r.citations, r.degraded, r.traversal_path) == (["a", "b", "c"], 3, "yes", ["a"], False, ["index", "a", "b", "c"])
    r = run(spark, chain, model('["a"]', '{"sufficient": true}'))
    assert (r.visited, r.hops) == (["a"], 1)
    r = run(spark, star, model('["a"]', '{"sufficient": false, "next_concept_ids": ["zz"]}'), max_hops=2)
    assert r.visited == ["a", "d", "c"]  # two at most, in document order


def test_degraded(spark, chain):
    r = run(spark, chain, model("no json", None, "just text"))
    assert (r.visited, r.hops, r.answer, r.citations, r.degraded_steps) == ([], 1, "just text", [], ["plan", "generate"])
    r = run(spark, chain, model('["a"]', "hm"))
    assert (r.visited, r.degraded_steps) == (["a"], ["decide"])
    r = run(spark, chain, model('["zz"]'))
    assert (r.visited, r.degraded, r.hops) == ([], False, 1)


def test_exhaustive_and_bounds(spark, chain):
    say = model('["a"]')
    assert run(spark, chain, say, strategy="exhaustive").visited == ["a", "b", "c"]
    assert run(spark, chain, say, strategy="exhaustive", max_concepts=2).visited == ["a", "b"]
    assert run(spark, chain, say, max_hops=0).visited == [] and run(spark, chain, say, max_concepts=0).hops == 0
    one = len("## Concept: a\n\n[b](b.md)") // 4
    assert run(spark, chain, say, strategy="exhaustive", token_budget=1 + one).visited == ["a"]  # exact fill
    blocked = run(spark, chain, say, strategy="exhaustive", token_budget=one)
    assert (blocked.visited, blocked.hops, blocked.tokens_used) == ([], 1, 1)
    for bad in ({"max_hops": -1}, {"max_concepts": -1}, {"token_budget": 0}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            run(spark, chain, say, **bad)
    with pytest.raises(ValueError):
        navigate(spark.createDataFrame([("1", " ")], "question_id string, question string"), chain.concepts, chain.edges, INDEX, say)


def test_explore_many(spark, chain):
    starts = spark.createDataFrame([("1", "?", ["a"]), ("2", "?", ["c", "b"]), ("3", "?", ["zz"])], "question_id string, question string, chosen array<string>")
    got = {r.question_id: r.visited for r in explore(starts, chain.concepts, chain.edges, INDEX).collect()}
    assert got == {"1": ["a", "b", "c"], "2": ["c", "b", "d", "a"], "3": []}


def test_payloads():
    assert json_payload('```json\n{"a": 1}\n```') == {"a": 1} and json_payload('so: {"a": [1]} ok') == {"a": [1]}
    assert json_payload("x [1, 2] y") == [1, 2] and json_payload("none") is None and json_payload("{bad} [1]") == [1]
    assert read_plan('["a"]') == ["a"] and read_plan('{"concept_ids": "a"}') is None and read_plan("{}") is None
    assert read_decision('{"sufficient": "yes"}') == (True, []) and read_decision('{"sufficient": 2}') is None
    assert read_answer(json.dumps({"answer": "x"})) == ("x", []) and read_answer('{"answer": 1}') is None
    assert response_text([{"text": "a"}, "b", {"image": 1}]) == "ab" and response_text(5) == "5"


def test_token_estimator(spark, chain):
    words = lambda text: len(text.split())
    index = spark.createDataFrame([("# I\n",)], "body string")
    assert (index_token_cost(index), index_token_cost(index, words)) == (1, 2)
    say = model('["a"]', '{"sufficient": true}')
    r = run(spark, chain, say, token_estimator=words)
    assert (r.visited, r.tokens_used) == (["a"], 2 + words("## Concept: a\n\n[b](b.md)"))
    assert run(spark, chain, say, token_estimator=words, token_budget=5).visited == []
    with pytest.raises(ValueError):
        run(spark, chain, say, token_estimator=words, token_budget=1)
    starts = spark.createDataFrame([("1", "why?", ["a"])], "question_id string, question string, chosen array<string>")
    got = explore(starts, chain.concepts, chain.edges, INDEX, token_estimator=words, token_budget=7).first()
    assert (got.visited, got.tokens_used) == (["a"], 6)
