"""The tree source: batches, streams, and what it does with bad names and files."""

import os
import time
import tracemalloc

import pyarrow as pa
import pytest

from tarnmark.plans.bundle import Bundle
from tarnmark.sources import tree
from tarnmark.sources.files import checked_root


@pytest.fixture()
def root(tmp_path):
    files = {"a.md": b"one", "log.md": b"-", "index.md": b"-", "x/_b.md": "zwei\r\ndrei\r".encode(), "x/.c/d.md": b"\xff", "x/.c/deep/er/e.md": b"", "x/f.txt": b"-", "y/index.md": b"-", "y/ü ñ.md": b"u"}
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


WANT = {
    ("a", "a.md", "one", None), ("x/_b", "x/_b.md", "zwei\ndrei\n", None), ("x/.c/d", "x/.c/d.md", None, "file is not valid UTF-8"),
    ("x/.c/deep/er/e", "x/.c/deep/er/e.md", "", None), ("y/ü ñ", "y/ü ñ.md", "u", None),
}


def rows(df):
    found = [(r.id, r.relative, r.raw, r.reason) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_every_file_comes_once(spark, root, tasks):
    assert rows(tree.read_tree(spark, root, tasks=tasks)) == WANT
    assert rows(tree.read_tree(spark, f"file://{root}", tasks=tasks)) == WANT


def test_the_driver_sees_upper_folders_only(root, monkeypatch):
    assert [(p.path, p.deep) for p in tree.folders_of(root, 1)] == [(root, True)]
    parts = tree.folders_of(root, 4)
    assert {(os.path.relpath(p.path, root), p.deep) for p in parts} == {(".", False), ("x", False), ("y", True), ("x/.c", True)}
    monkeypatch.setattr(tree, "LOOK", 2)
    few = tree.folders_of(root, 6)
    assert all(p.path == root and p.deep for p in few) and [p.share for p in few] == list(range(6)) and {p.shares for p in few} == {6}


def test_links(spark, root, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    (other / "o.md").write_text("far")
    os.symlink(other / "o.md", f"{root}/out.md")
    os.symlink(f"{root}/a.md", f"{root}/x/again.md")
    os.symlink(f"{root}/x/f.txt", f"{root}/y/text.md")
    os.symlink(other, f"{root}/z")
    assert rows(tree.read_tree(spark, root)) == WANT | {("out", "out.md", None, tree.OUTSIDE), ("x/f.txt", "x/f.txt", "-", None)}


def test_folders_that_cannot_be_listed_are_rows(root, monkeypatch):
    real = tree._entries

    def entries(folder):
        if folder.endswith("/.c"):
            raise PermissionError(13, "Permission denied")
        return real(folder)

    monkeypatch.setattr(tree, "_entries", entries)
    reader = tree.TreeReader({"path": root, "tasks": "3"})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {(r["relative"], r["reason"]) for r in got if r["reason"]} == {("x/.c", "folder could not be read: Permission denied")}
    assert {r["id"] for r in got} == {"a", "x/_b", "y/ü ñ", "x/.c"}


def test_bundle_over_a_tree_of_many_folders(spark, tmp_path):
    n = 300
    notes = spark.range(n).selectExpr("concat('f', id % 7, '/g', id % 3, '/n', id, '.md') as relative", "concat('---\\ntype: t\\n---\\n[x](n', id + 21, '.md)\\n') as content")
    assert tree.write_tree(notes, str(tmp_path)) == n
    bundle = Bundle.load(spark, str(tmp_path))
    assert bundle.concept_count == n and bundle.edges.where("resolved").count() == n - 21
    assert bundle.skipped.count() == 0


def test_repeated_ids_of_given_notes(spark):
    note = lambda text: f"---\ntype: t\ntitle: {text}\n---\n"
    df = spark.createDataFrame([("a", "/r/a.md", note("first")), ("a", "/r/b.md", note("last")), ("c", "/r/c.md", note("c")), ("bad", "/r/x/bad.md", "-")], "id string, path string, raw string")
    bundle = Bundle.of_notes(df, "/r")
    assert [(r.id, r.title) for r in bundle.all_concepts().collect()] == [("a", "last"), ("c", "c")]
    assert [r.path for r in bundle.skipped.collect()] == ["x/bad.md"]


def test_a_stream_takes_new_and_changed_files(spark, root, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")
    past = time.time() - 100
    for folder, _, names in os.walk(root):
        for name in names:
            os.utime(f"{folder}/{name}", (past, past))

    def arrived():
        rows_ = tree.stream_tree(spark, root, settle=0)
        q = rows_.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(tree.SCHEMA).parquet(str(at / "out"))

    assert rows(arrived()) == WANT
    (tmp := open(f"{root}/x/_b.md", "w")).write("changed"), tmp.close()
    (tmp := open(f"{root}/new.md", "w")).write("new"), tmp.close()
    time.sleep(0.1)
    assert rows(arrived()) == WANT | {("x/_b", "x/_b.md", "changed", None), ("new", "new.md", "new", None)}
    assert arrived().count() == len(WANT) + 2


def test_roots(tmp_path):
    assert checked_root(f"{tmp_path}/x/..") == str(tmp_path) if (tmp_path / "x").mkdir() is None else None
    with pytest.raises(Exception, match="not found"):
        checked_root(f"file://{tmp_path}/none")


def test_a_writer_does_not_hold_its_files_twice(tmp_path):
    size, n = 1 << 18, 100
    batch = pa.RecordBatch.from_pylist([{"relative": f"a/{i}.md", "content": bytes([i]) * size} for i in range(n)])
    tracemalloc.start()
    try:
        out = [b.to_pylist() for b in tree._writer(str(tmp_path))(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out == [[{"n": n}]] and peak < 8 * size  # all of them as bytes: n * size
    assert all((tmp_path / f"a/{i}.md").read_bytes() == bytes([i]) * size for i in range(n))
    assert [b.to_pylist() for b in tree._writer(str(tmp_path))(iter([]))] == [[{"n": 0}]]
