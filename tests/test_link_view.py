"""The maintained view of links against resolution over everything."""

import random

import pytest

from tarnmark.operators.link_view import EDGE, LinkView
from tarnmark.operators.links import resolve
from tarnmark.operators.parsing import occurrences

LINK = "array<struct<edge_pos: int, target_id: string, anchor_text: string, link_kind: string>>"
KIND = f"id string, title string, aliases array<string>, links {LINK}"


def rows(df):
    return sorted(tuple(r) for r in df.select(EDGE).collect())


def note(rng, i):
    links = []
    for k in range(rng.randrange(4)):
        kind = rng.choice(["wiki", "markdown"])
        target = rng.choice([f"t{rng.randrange(6)}", f"n{rng.randrange(14)}", "shared"]) if kind == "wiki" else f"f/n{rng.randrange(14)}"
        links.append((k, target, f"say {target}", kind))
    return (f"f/n{i}", rng.choice([None, "", f"T{rng.randrange(6)}"]), rng.choice([None, [], ["Shared"], [f"t{rng.randrange(6)}", "shared"]]), links)


def test_view_follows_any_changes(spark, tmp_path):
    rng = random.Random(6)
    view, held = LinkView(spark, str(tmp_path / "v"), buckets=4, compact_after=3), {}
    for batch in range(6):
        put = {i: note(rng, i) for i in rng.sample(range(14), 12 if batch == 0 else rng.randrange(4))}
        gone = set(rng.sample(range(14), 2)) - set(put) if batch else set()
        df = spark.createDataFrame(list(put.values()), KIND)
        away = spark.createDataFrame([(f"f/n{i}",) for i in gone], "id string")
        assert view.update(df, away, batch=batch)
        held = {k: v for k, v in (held | put).items() if k not in gone}
        everything = spark.createDataFrame(list(held.values()), KIND)
        assert rows(view.edges()) == rows(resolve(occurrences(everything), everything))
    assert not view.update(df, away, batch=5)


def test_only_touched_edges_resolve_anew(spark, tmp_path):
    plain = [(f"n{i}", f"Title {i}", None, [(0, f"title {(i + 1) % 50}", "x", "wiki"), (1, f"n{(i + 2) % 50}", "y", "markdown")]) for i in range(50)]
    view = LinkView(spark, str(tmp_path / "v"))
    view.update(spark.createDataFrame(plain, KIND))
    assert view.resolved == 100 and view.edges().where("resolved").count() == 100
    view.update(spark.createDataFrame([("n7", "Other", None, [(0, "title 7", "x", "wiki")])], KIND))
    assert view.resolved == 2  # its own link, and the one that looked its title up
    view.update(spark.createDataFrame([("extra", "Title 9", None, [])], KIND))
    assert view.resolved == 1 and view.edges().where("ambiguous").count() == 1
    view.update(spark.createDataFrame([], KIND), spark.createDataFrame([("extra",), ("n9",)], "id string"))
    left = view.edges()
    assert left.where("source_id = 'n9'").count() == 0
    assert sorted((r.source_id, r.target_id) for r in left.where("not resolved").collect()) == [("n6", "title 7"), ("n7", "title 7"), ("n8", "title 9")]


def test_a_repeated_update_after_a_failure(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    first = [note(rng, i) for i in range(10)]
    second = [note(rng, i) for i in range(5, 13)]
    view = LinkView(spark, str(tmp_path / "v"), buckets=2)
    view.update(spark.createDataFrame(first, KIND), batch=0)
    write = view.links.write
    monkeypatch.setattr(view.links, "write", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        view.update(spark.createDataFrame(second, KIND), batch=1)
    monkeypatch.setattr(view.links, "write", write)
    assert view.update(spark.createDataFrame(second, KIND), batch=1)
    everything = spark.createDataFrame([x for x in first if x[0] not in {y[0] for y in second}] + second, KIND)
    assert rows(view.edges()) == rows(resolve(occurrences(everything), everything))
