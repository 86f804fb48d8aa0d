"""The delta store against a dictionary."""

import os
import random

import pytest

from tarnmark.errors import StorageError
from tarnmark.operators import delta_store, sync
from tarnmark.operators.delta_store import COLUMNS, STORE, DeltaStore
from tarnmark.streaming.incremental import latest_of, sync_stream


def frame(spark, rows):
    """Rows (doc_id, text) of a store."""
    return spark.createDataFrame([(i, f"c{i}", t, "{}", f"h{t}") for i, t in rows], STORE)


def held(df):
    rows = [(r.doc_id, r.page_content) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def size(path, folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{path}/{folder}") for f in files if f.endswith(".parquet"))


def test_any_sequence_of_batches(spark, tmp_path):
    rng = random.Random(5)
    store, want, at = DeltaStore(spark, str(tmp_path / "s"), buckets=4, compact_after=3), {}, {}
    for batch in range(8):
        put = {f"d{rng.randrange(40)}": f"t{batch}-{k}" for k in range(rng.randrange(0, 12))}
        gone = {f"d{rng.randrange(40)}" for _ in range(rng.randrange(3))} - set(put)
        assert store.write(frame(spark, put.items()), batch=batch, gone=spark.createDataFrame([(i,) for i in gone], "doc_id string"))
        want = {k: v for k, v in (want | put).items() if k not in gone}
        at[store.state()["version"]] = dict(want)
        assert held(store.read()) == want
        assert len(store.state()["deltas"]) < 3
    assert {r.doc_id: r.content_hash for r in store.read(columns=["content_hash"]).collect()} == {k: f"h{v}" for k, v in want.items()}
    assert all(held(store.read(v)) == rows for v, rows in at.items())
    store.compact()
    assert held(store.read()) == want and not store.state()["deltas"]
    assert store.vacuum() and held(store.read()) == want
    assert store.versions() == [store.state()["version"]]
    with pytest.raises(StorageError):
        store.read(1)
    assert held(DeltaStore(spark, str(tmp_path / "none")).read()) == {}


def test_a_small_batch_writes_little(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path / "s"))
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(400))
    rows = [(f"d{i}", text()) for i in range(5000)]
    docs = frame(spark, rows)
    assert {r.status for r in store.sync(docs).select("status").distinct().collect()} == {"added"}
    changed = frame(spark, [(i, t if k % 100 else text()) for k, (i, t) in enumerate(rows)])
    status = store.sync(changed)
    assert status.groupBy("status").count().orderBy("status").collect() == [("skipped", 4950), ("updated", 50)]
    first, second = (size(tmp_path / "s", d["folder"]) for d in store.state()["deltas"])
    assert second < 0.03 * first
    before = store.state()
    assert store.sync(changed).where("status <> 'skipped'").isEmpty()
    assert store.state()["deltas"] == before["deltas"]
    assert held(store.read()) == {r.doc_id: r.page_content for r in changed.collect()}


def test_compaction_leaves_other_buckets(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path / "s"), buckets=8)
    store.write(frame(spark, [(f"d{i}", "x") for i in range(100)]))
    store.compact()
    base = store.state()["base"]
    store.write(frame(spark, [("d7", "y")]))
    touched = store.state()["deltas"][0]["buckets"]
    store.compact()
    assert len(touched) == 1 and {b for b, f in store.state()["base"].items() if f != base[b]} == {str(touched[0])}
    assert held(store.read())["d7"] == "y" and store.read().count() == 100
    store.delete(spark.createDataFrame([(f"d{i}",) for i in range(100)], "doc_id string"))
    store.compact()
    assert store.read().count() == 0 and store.state()["base"] == {}


def test_repeats_are_refused_and_batches_count_once(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path / "s"))
    twice = frame(spark, [("a", "1"), ("b", "2"), ("a", "3")])
    with pytest.raises(ValueError, match="'a' comes 2 times"):
        store.write(twice)
    with pytest.raises(ValueError):
        store.write(frame(spark, [("a", "1")]), gone=spark.createDataFrame([("a",)], "doc_id string"))
    assert store.versions() == []
    assert store.write(frame(spark, [("a", "1")]), batch=4)
    assert not store.write(frame(spark, [("a", "2")]), batch=4) and not store.write(frame(spark, [("a", "2")]), batch=3)
    assert held(store.read()) == {"a": "1"}
    with pytest.raises(StorageError):
        store._commit(store.state())
    for side in ((twice, frame(spark, [("c", "1")])), (frame(spark, [("c", "1")]), twice)):
        status = side[1].select(*COLUMNS).selectExpr("*", "'added' as status")
        with pytest.raises(ValueError):
            sync.merged(side[0], status)
    with pytest.raises(ValueError):
        DeltaStore(spark, "x", buckets=0)


def test_a_stream_appends_what_changed(spark, tmp_path):
    note = lambda i, text: (f"n/{i}", f"n/{i}.md", f"---\ntype: t\n---\n{text}\n")
    kind, at = "id string, path string, raw string", str(tmp_path / "in")
    store = DeltaStore(spark, str(tmp_path / "store"))

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(at)
        sync_stream(spark.readStream.schema(kind).parquet(at), store, "/kb", str(tmp_path / "state")).awaitTermination()

    arrive([note(i, f"text {i}") for i in range(30)])
    arrive([note(i, f"text {i}") for i in range(10)] + [note(5, "text zz"), note(40, "new")])
    rows = {r.concept_id: r.page_content for r in store.read().collect()}
    assert len(rows) == 31 and rows["n/5"] == "text zz\n" and rows["n/40"] == "new\n"
    parts = [spark.read.parquet(str(tmp_path / "store" / d["folder"])).count() for d in store.state()["deltas"]]
    assert parts == [30, 2] and store.state()["batch"] == 1


def test_latest_of_repeats(spark):
    rows = [("a", "p", "zz", 1), ("a", "p", "aa", 2), ("b", "p", "x", 1)]
    df = spark.createDataFrame(rows, "id string, path string, raw string, modified int")
    assert {r.id: r.raw for r in latest_of(df).collect()} == {"a": "aa", "b": "x"}
    assert {r.id: r.raw for r in latest_of(df.drop("modified")).collect()} == {"a": "zz", "b": "x"}


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_compaction_by_keys_that_are_sent_or_shuffled(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(delta_store, "SENT_KEYS", sent)
    rng = random.Random(sent)
    store, want = DeltaStore(spark, str(tmp_path / "s"), buckets=3), {}
    for batch in range(6):
        put = {f"d{rng.randrange(20)}": f"t{batch}-{k}" for k in range(9)}
        gone = {f"d{rng.randrange(20)}" for _ in range(3)} - set(put)
        store.write(frame(spark, put.items()), gone=spark.createDataFrame([(i,) for i in gone], "doc_id string"))
        want = {k: v for k, v in (want | put).items() if k not in gone}
        if batch % 3 == 2:
            store.compact()
            assert held(store.read()) == want and not store.state()["deltas"]


def test_whole_rows_are_written_once_and_compacted_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Volume: a sync writes contents as its status and its delta, and the first one shuffles none before; compaction moves keys only."""
    seen, real = [], delta_store.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    monkeypatch.setattr(delta_store, "materialize", lambda df, name: seen.append((name, "page_content" in df.columns, plan(df))) or real(df, name))
    store = DeltaStore(spark, str(tmp_path / "s"))
    store.sync(frame(spark, [(f"d{i}", "x") for i in range(50)]))
    assert [name for name, whole, _ in seen if whole] == ["status"] and "Exchange" not in seen[0][2]
    store.sync(frame(spark, [(f"d{i}", "y") for i in range(5)]))
    assert [name for name, whole, _ in seen if whole] == ["status"] * 2
    state = store.state()
    assert "Exchange" not in plan(store._compacted(state, store._touched(state))[0])
    store.compact()
    assert not any(whole for name, whole, _ in seen if name != "status")
    assert held(store.read()) == {f"d{i}": "y" if i < 5 else "x" for i in range(50)}
