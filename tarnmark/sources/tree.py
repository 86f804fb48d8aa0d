"""A directory tree of Markdown files as a Spark data source, in batches or as a stream.

``spark.read.format("note_tree").load(root)`` gives a row for each concept file:
id, path, relative, raw, reason, modified. Partitions are folders. The driver looks
into the upper folders only, until there are enough of them or it has seen LOOK
names; tasks list what lies below and read the files. A folder that stands for
many files is dealt to several tasks, each taking the names of its share of a
hash. What cannot be read (a file, or a folder below the root) is a row with a
reason, never a failed task.

Names that start with a dot or an underscore count, which Spark's own file sources
leave out. A link to a file in the tree that is listed under its own name is left
out; one that leads outside is a row with a reason.

As a stream, a batch holds the files whose time of change is after the last batch
and SETTLE seconds ago at least; a changed file comes again with its new text.

Options: ``tasks`` (folders or shares that are aimed at), ``settle``.
"""

from __future__ import annotations

import datetime
import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tarnmark.sources.files import checked_root, decode, is_concept, is_local

SCHEMA = "id string, path string, relative string, raw string, reason string, modified timestamp"
_ARROW = pa.schema([(n, pa.string()) for n in ("id", "path", "relative", "raw", "reason")] + [("modified", pa.timestamp("us", tz="UTC"))])
#: Partitions that are aimed at, names that the driver looks at, seconds that a file rests before a stream takes it; rows and bytes of a batch.
TASKS, LOOK, SETTLE, ROWS, BYTES = 64, 10_000, 1.0, 256, 16 << 20
OUTSIDE = "concept file lies outside the bundle root"


@dataclass
class Folder(InputPartition):
    """A folder, with all below it or by itself, and which share of its names is meant."""

    path: str
    deep: bool
    share: int = 0
    shares: int = 1
    after: float = float("-inf")
    until: float = float("inf")


def _entries(folder: str) -> Iterator[tuple[str, bool, float]]:
    """(path, is a folder, time of change) of what lies in a folder; links to folders are not followed. Names in addresses are quoted."""
    if is_local(folder):
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.path, True, 0.0
                elif e.is_file():
                    yield e.path, False, e.stat().st_mtime
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    for info in store.get_file_info(fs.FileSelector(base)):
        if info.type in (fs.FileType.Directory, fs.FileType.File):
            yield f"{folder.rstrip('/')}/{quote(info.base_name)}", info.type == fs.FileType.Directory, info.mtime_ns / 1e9 if info.mtime_ns else 0.0


def folders_of(root: str, tasks: int) -> list[Folder]:
    """About ``tasks`` partitions that hold the whole tree between them."""
    deep, flat, seen = [root], [], 0
    while deep and len(deep) + len(flat) < tasks and seen < LOOK:
        top = deep.pop(0)
        below, looked = [], 0
        try:
            for path, is_folder, _ in _entries(top):
                looked += 1
                if is_folder:
                    below.append(path)
                if seen + looked >= LOOK:
                    break
        except OSError:
            flat.append(top)  # its task tells why
            continue
        seen += looked
        if seen >= LOOK:
            deep.append(top)  # too much to look at here: its tasks do
        else:
            flat.append(top)
            deep += below
    shares = max(1, -(-tasks // max(1, len(deep) + len(flat))))
    return [Folder(p, d, k, shares) for paths, d in ((deep, True), (flat, False)) for p in paths for k in range(shares)]


class _Tree:
    def __init__(self, options: dict):
        self.root, self.tasks = checked_root(options["path"]), int(options.get("tasks", TASKS))

    def _relative(self, path: str) -> str:
        relative = path[len(self.root) :].lstrip("/")
        return relative if is_local(path) else unquote(relative)

    def _row(self, path: str) -> dict | None:
        """The row of a file, without its time; None for a link to a file that is listed anyway."""
        relative = self._relative(path)
        if is_local(path) and os.path.islink(path):
            real = os.path.realpath(path)
            if not real.startswith(self.root + "/"):
                return {"id": relative.removesuffix(".md"), "path": path, "relative": relative, "raw": None, "reason": OUTSIDE}
            if is_concept(os.path.basename(real)):
                return None
            path, relative = real, real[len(self.root) + 1 :]
        raw, reason = decode(path)
        return {"id": relative.removesuffix(".md"), "path": f"{self.root}/{relative}", "relative": relative, "raw": raw, "reason": reason}

    def _listed(self, part: Folder) -> Iterator[tuple[str, float | None]]:
        """(path, time of change) of the concept files of a partition; (folder, None) for one that cannot be listed."""
        waiting = [part.path]
        while waiting:
            folder = waiting.pop()
            try:
                for path, is_folder, changed in _entries(folder):
                    name = self._relative(path).rpartition("/")[2]
                    if is_folder:
                        if part.deep:
                            waiting.append(path)
                    elif is_concept(name) and zlib.crc32(path.encode("utf-8", "surrogateescape")) % part.shares == part.share and part.after < changed <= part.until:
                        yield path, changed
            except OSError as e:
                if part.share == 0:
                    yield f"{folder}\0{e.strerror or type(e).__name__}", None

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, changed in self._listed(part):
            if changed is None:
                folder, _, why = path.partition("\0")
                relative = self._relative(folder)
                row = {"id": relative, "path": folder, "relative": relative, "raw": None, "reason": f"folder could not be read: {why}"}
            else:
                row = self._row(path)
                if row is None:
                    continue
                row["modified"] = datetime.datetime.fromtimestamp(changed, datetime.UTC)
            rows.append(row)
            size += len(row["raw"] or "")
            if len(rows) == ROWS or size >= BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        pa.default_memory_pool().release_unused()  # a worker is kept for later tasks


class TreeReader(_Tree, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return folders_of(self.root, self.tasks)


class TreeStreamReader(_Tree, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.settle = float(options.get("settle", SETTLE))

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's names
        return {"until": 0.0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        out = folders_of(self.root, self.tasks)
        for part in out:
            part.after, part.until = start["until"], end["until"]
        return out

    def commit(self, end: dict) -> None:
        pass


class NoteTree(DataSource):
    """The source under its name ``note_tree``."""

    @classmethod
    def name(cls) -> str:
        return "note_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:  # noqa: N802
        return TreeStreamReader(self.options)


def read_tree(spark: SparkSession, root: str, *, tasks: int = TASKS) -> DataFrame:
    """The rows of a tree (id, path, relative, raw, reason, modified)."""
    spark.dataSource.register(NoteTree)
    return spark.read.format("note_tree").option("tasks", str(tasks)).load(root)


def stream_tree(spark: SparkSession, root: str, *, tasks: int = TASKS, settle: float = SETTLE) -> DataFrame:
    """The same rows as a stream of what is new or changed."""
    spark.dataSource.register(NoteTree)
    return spark.readStream.format("note_tree").option("tasks", str(tasks)).option("settle", str(settle)).load(root)


def _writer(root: str):
    """Rows (relative, content) to files below a root, and one row with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if not is_local(root) else (fs.LocalFileSystem(), root)
        made, n = set(), 0
        for batch in batches:
            for relative, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                folder = f"{base}/{relative}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{relative}") as f:
                    f.write(content.as_buffer())  # bytes of the batch itself: files are not held beside it
                n += 1
        batch = content = None
        pa.default_memory_pool().release_unused()  # a worker is kept for later tasks
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


def write_tree(notes: DataFrame, root: str) -> int:
    """Write notes (relative, content) as files below a root, a task each its own; how many were written."""
    return notes.selectExpr("relative", "cast(content as binary) as content").mapInArrow(_writer(root), "n long").groupBy().sum("n").first()[0] or 0
