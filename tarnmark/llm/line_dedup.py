"""Line dedup over levelled sorted runs of line hashes.

The key of a line is the line without white space at its ends, A-Z lowered. What
is known of keys lies in runs: tables bucketed by key and sorted within each
bucket, with one row a key: in how many documents it was found, and the largest
doc_id of these. A new batch counts its own keys, merge-anti-joins every run (a
key that a run has settled, with enough documents and a larger doc_id, needs no
further row) and adds what is left as a run of its own. Two runs of a level are
compacted into one of the next. Runs are read by bucket, so neither the
anti-joins nor the compactions move them again.

Documents arrive in batches of falling doc_id; then a common line is settled in
the runs after a few batches and costs no more than its count in each batch. Any
other order gives the same totals. Afterwards each key with enough documents is
joined with the documents that hold it, and these lose its lines, all but the
document of the largest id.

Keys are 128-bit digests: among a trillion lines, two different ones share a
digest with chance 1e-15.

Defined results: a null or empty text is one empty line; rows that share a doc_id
are one document, and each loses its lines for itself; rows without doc_id are
one document together, smaller than any other (a doc_id of the smallest long
counts with them); a key found in few documents stays however often one document
repeats it; a text that loses all lines is empty; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import fresh_path, materialize, per_batch, table, text_or_empty, utf8
from tarnmark.storage import discard

#: What is stripped from both ends of a line, the code points of a key, and the documents that must hold it.
WHITE, LEAST_CHARS, LEAST_DOCUMENTS = b" \t\n\x0b\x0c\r", 20, 3
#: Batches of the query.
BATCHES = 4


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The digest of a line's key; None if the key is shorter than ``least`` code points."""
    key = line.strip(WHITE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def line_keys(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc, key): the different keys of each row's lines."""

    def make() -> Callable:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [{k for line in text.split(b"\n") if (k := line_key(line, least))} for text in utf8(batch.column(1))]
            doc = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([k for x in found for k in x], pa.binary())], names=["doc", "key"])

        return step

    return docs.select(_document().alias("doc"), text_or_empty().alias("text")).mapInArrow(per_batch(make), "doc long, key binary")


class LineRuns:
    """Levels of sorted runs (key, n, last) in the shared folder; rows of a key in several runs add up."""

    def __init__(self, spark: SparkSession, *, least: int = LEAST_DOCUMENTS, buckets: int | None = None):
        self.spark, self.least = spark, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex[:16]}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", fresh_path(self.spark, name)).saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            files = self.spark.table(name)
            files.written_to = next(iter(files.inputFiles()), "").rpartition("/")[0]
            self.spark.sql(f"DROP TABLE {name}")
            discard(files)

    def _merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one: a merge join of equal buckets, which moves no rows."""
        a, b = (self.spark.table(x).select(*[F.col(c).alias(f"{c}_{k}") for c in ("key", "n", "last")]) for k, x in enumerate((one, other)))
        both = a.hint("merge").join(b, F.col("key_0") == F.col("key_1"), "full")
        n = F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))
        return both.select(F.coalesce("key_0", "key_1").alias("key"), n.alias("n"), F.greatest("last_0", "last_1").alias("last"))

    def _compact(self, one: str, other: str, level: int) -> None:
        self._write(self._merged(one, other), level)
        self._drop([one, other])

    def add(self, keys: DataFrame) -> None:
        """A batch of rows (doc, key); a document must not come in two batches."""
        own = keys.groupBy("key").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last"))
        for name in [x for level in self.levels for x in level]:
            run = self.spark.table(name).where(F.col("n") >= self.least).select(F.col("key").alias("known"), F.col("last").alias("known_last"))
            own = own.join(run.hint("merge"), (F.col("key") == F.col("known")) & (F.col("known_last") >= F.col("last")), "left_anti")
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) == 2:
            pair, self.levels[level] = self.levels[level], []
            self._compact(*pair, level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """(key, last) of the keys found in ``least`` documents or more."""
        names = [x for level in self.levels for x in level]
        if not names:
            return self.spark.createDataFrame([], "key binary, last long")
        self.levels = [[]] * len(self.levels)
        while len(names) > 1:  # the smallest levels first
            self._compact(*names[:2], len(self.levels))
            names = [self.levels.pop()[0], *names[2:]]
        self.levels = [names]
        return self.spark.table(names[0]).where(F.col("n") >= self.least).select("key", "last")

    def close(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def _kept(rows: DataFrame, least: int) -> DataFrame:
    """Rows (doc_id, text, gone) to (doc_id, text, n_lines, n_dropped) without the lines whose keys are gone."""

    def make() -> Callable:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, lines, dropped = [], [], []
            for text, gone in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                lines.append(text.count(b"\n") + 1)
                if gone:
                    gone = set(gone)
                    stay = [x for x in text.split(b"\n") if line_key(x, least) not in gone]
                    dropped.append(lines[-1] - len(stay))
                    text = b"\n".join(stay)
                else:
                    dropped.append(0)
                texts.append(text)
            columns = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_lines", "n_dropped"])

        return step

    return rows.mapInArrow(per_batch(make), "doc_id long, text string, n_lines long, n_dropped long")


def _by_batch(keys: DataFrame, docs: DataFrame, batches: int) -> tuple[str, list[int]]:
    """Keys written once, in folders by batch: ranges of falling doc_id with about as many documents each."""
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(_document(), shares, 10_000).alias("c")).first().c if shares else []
    number = F.lit(0)
    for cut in set(cuts or []):
        number += F.when(F.col("doc") <= cut, 1).otherwise(0)
    path = fresh_path(docs.sparkSession, "line-keys")
    keys.withColumn("batch", number).write.partitionBy("batch").parquet(path)
    return path, list(range(len(set(cuts or [])) + 1))


def deduplicated(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of rows (doc_id, text): repeated lines stay in one document only."""
    if least_chars < 1 or least_documents < 1 or batches < 1:
        raise ValueError("least_chars, least_documents and batches must be at least 1")
    spark = docs.sparkSession
    path, numbers = _by_batch(line_keys(docs, least_chars), docs, batches)
    keys = spark.read.schema("doc long, key binary, batch int").parquet(path)
    keys.written_to = path
    runs = LineRuns(spark, least=least_documents)
    for number in numbers:
        runs.add(keys.where(F.col("batch") == number).select("doc", "key"))
    frequent = materialize(runs.frequent(), "frequent-lines")
    runs.close()
    # both sides of each join are plain tables, so that Spark can split the rows of a common line
    held = keys.select("doc", "key").join(frequent, "key").where("doc < last")
    gone = materialize(held.groupBy("doc").agg(F.collect_set("key").alias("gone")), "gone-lines")
    discard(keys, frequent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _document().alias("doc"), text_or_empty().alias("text"))
    return _kept(rows.join(gone, "doc", "left").select("doc_id", "text", "gone"), least_chars)


def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: every line of all documents."""
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""WITH l AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
f AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
k AS (SELECT l.*, coalesce(l.doc_id < f.last, false) AS gone FROM l LEFT JOIN f ON f.key = l.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id"""
