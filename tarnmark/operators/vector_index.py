"""Exact nearest vectors for a table of queries, from a store that is cut into rings around centroids.

Vectors are dealt to the nearest of some centroids and sorted by their angle to
it; runs of BLOCK_ROWS of them are the blocks of the store, each a row with its
vectors and the angles where it begins and ends (a ring). By the triangle
inequality on the sphere, a query whose own angle to the centroid is a comes no
nearer to a vector of the ring than the distance of a from the ring.

A search first compares each query with the one block that promises most, which
gives a k-th similarity to beat, and then with just those blocks whose bound does
not rule them out. Queries stay a table all along: they meet blocks by equi-joins
on the centroid and the block, in groups of GROUP_ROWS or so, and numpy
multiplies a group with a block. A centroid with a third of all vectors has its
vectors in many blocks, each a row of its own.

Centroids are fitted on a bounded sample; they decide how much is pruned, never
what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarnmark.storage import discard, fresh_path, materialize

#: Vectors of a block, queries of a group, vectors that centroids are fitted on, centroids at most, rounds of the fit.
BLOCK_ROWS, GROUP_ROWS, SAMPLE, MOST_CENTROIDS, FIT_ROUNDS = 1024, 256, 20_000, 1024, 6
#: Angles are trusted to this much.
SLACK = 1e-6
#: The centroid of vectors without length; they are similar to nothing.
NOWHERE = -1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(x, axis=1)
    return x / np.where(norms > 0, norms, 1)[:, None], norms


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def fit_centroids(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centroids of a sample: spherical means, started evenly over the sample."""
    x, norms = _unit(x)
    x = x[norms > 0]
    if not len(x):
        return x
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        means, size = _unit(sums)
        c = np.where(size[:, None] > 0, means, c)
    return c


class VectorIndex:
    """A store (doc_id, embedding) in blocks; ``build`` writes one."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray):
        self.spark, self.path, self.centroids = spark, path, centroids
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.rings = self.blocks.select("block", "centroid", "low", "high", "n")
        self.computed = self.possible = 0

    @classmethod
    def build(cls, store: DataFrame, *, centroids: int | None = None, path: str | None = None) -> "VectorIndex":
        """Of vectors of equal length; rows without a vector are left out."""
        spark, path = store.sparkSession, path or fresh_path(store.sparkSession, "vector-index")
        rows = store.select("doc_id", F.col("embedding").cast("array<double>").alias("x")).where("x is not null")
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("doc_id")).limit(SAMPLE).select("x").toArrow().column("x").combine_chunks()  # SAMPLE rows
        k = centroids or max(1, min(MOST_CENTROIDS, int(np.sqrt(n) / 2)))
        c = fit_centroids(_matrix(sample), k)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, norms = _unit(_matrix(batch.column("x")))
                    near, angle = np.full(len(x), NOWHERE), np.zeros(len(x))
                    if len(c):
                        angles = _angles(x, c)
                        near, angle = angles.argmin(axis=1), angles.min(axis=1)
                    near[norms == 0], angle[norms == 0] = NOWHERE, 0
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(angle)], names=["doc_id", "x", "centroid", "angle"])

        key = store.schema["doc_id"].dataType
        kind = to_arrow_type(key)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, number = [], TaskContext.get().partitionId() << 32

            def block(rows: list[dict]) -> pa.RecordBatch:
                nonlocal number
                number += 1
                columns = [[number], [rows[0]["centroid"]], [rows[0]["angle"]], [rows[-1]["angle"]], [len(rows)], [[r["doc_id"] for r in rows]], [[v for r in rows for v in r["x"]]]]
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(kind), pa.list_(pa.float64()))
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["block", "centroid", "low", "high", "n", "ids", "vectors"])

            for batch in batches:
                for row in batch.to_pylist():
                    if waiting and (row["centroid"] != waiting[0]["centroid"] or len(waiting) == BLOCK_ROWS):
                        yield block(waiting)
                        waiting = []
                    waiting.append(row)
            if waiting:
                yield block(waiting)

        placed = materialize(rows.mapInArrow(dealt, f"doc_id {key.simpleString()}, x array<double>, centroid int, angle double"), "placed")
        inner = placed.repartitionByRange("centroid", "angle", "doc_id").sortWithinPartitions("centroid", "angle", "doc_id")
        kinds = f"block long, centroid int, low double, high double, n int, ids array<{key.simpleString()}>, vectors array<double>"
        inner.mapInArrow(cut, kinds).write.parquet(f"{path}/blocks")
        discard(placed)
        return cls(spark, path, c)

    def delete(self) -> None:
        files = self.blocks.select("block")
        files.written_to = self.path
        discard(files)

    def _first_ids(self, blocks: DataFrame, k: int) -> Column:
        """The k smallest ids of some blocks, as an array."""
        kind = self.blocks.schema["ids"].dataType
        rows = blocks.select(F.explode("ids").alias("doc_id")).orderBy("doc_id").limit(k).collect()  # k rows
        return F.array(*[F.lit(r.doc_id) for r in rows]).cast(kind)

    def _ahead(self, asked: DataFrame, first: bool) -> DataFrame:
        """(query_id, centroid, a): each query's angle to the nearest centroid (``first``) or to all that its ``most`` angle admits."""
        c = self.centroids
        reach = {r.centroid: r.reach for r in self.rings.groupBy("centroid").agg(F.max("high").alias("reach")).collect()}  # a row a centroid
        own = np.array([reach.get(i, -np.inf) for i in range(len(c))])
        kind = asked.schema["query_id"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(c):
                    angles = _angles(_unit(_matrix(batch.column("x")))[0], c)
                    if first:
                        rows, which = np.arange(len(angles)), np.where(own >= 0, angles, np.inf).argmin(axis=1)
                    else:
                        most = batch.column("most").to_numpy()
                        rows, which = np.nonzero(angles - own[None, :] <= most[:, None] + SLACK)
                    columns = [batch.column("query_id").take(pa.array(rows)), pa.array(which, pa.int32()), pa.array(angles[rows, which])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "centroid", "a"])

        return asked.mapInArrow(run, f"query_id {kind.simpleString()}, centroid int, a double")

    def _compared(self, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, similarity, near) of the best k of each pair (query_id, block); nothing below what a query has already."""
        spark, key, kind = self.spark, self.blocks.schema["ids"].dataType.elementType, asked.schema["query_id"].dataType
        groups = max(1, -(-asked.count() // GROUP_ROWS))
        query = F.struct("query_id", "x", "beat")
        met = pairs.join(asked, "query_id").groupBy("block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")).agg(F.collect_list(query).alias("q"))
        met = materialize(met, "met")
        counted = met.join(self.rings, "block").agg(F.sum(F.col("n") * F.size("q")).alias("s")).first().s
        self.computed += counted or 0
        asked_type, doc_type = to_arrow_type(kind), to_arrow_type(key)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    ids, q = batch.column("ids")[at].values, batch.column("q")[at].values
                    x = batch.column("vectors")[at].values.to_numpy().reshape(len(ids), -1)
                    y, beat = _matrix(q.field("x")), q.field("beat").to_numpy()
                    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
                    sim = np.divide(x @ y.T, size, out=np.zeros_like(size), where=size > 0)
                    near, n = np.round(sim, 12), min(k, len(ids))
                    edge = np.partition(near, len(ids) - n, axis=0)[len(ids) - n]
                    rows, cols = np.nonzero(near >= np.maximum(edge, beat)[None, :])  # ties at the edge included
                    if len(rows):
                        columns = [q.field("query_id").take(pa.array(cols)), ids.take(pa.array(rows)), pa.array(sim[rows, cols]), pa.array(near[rows, cols])]
                        kinds = (asked_type, doc_type, pa.float64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], names=["query_id", "doc_id", "similarity", "near"])

        out = met.join(self.blocks.select("block", "ids", "vectors"), "block").mapInArrow(run, f"query_id {kind.simpleString()}, doc_id {key.simpleString()}, similarity double, near double")
        out = materialize(out, "compared")
        discard(met)
        return out

    def nearest(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, hit_rank, doc_id, similarity): cosine to twelve digits, ties by doc_id, zero vectors at 0.0."""
        if k < 1:
            raise ValueError(f"k must be at least 1, got {k}")
        length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("x")).where("x is not null")
        asked = materialize(asked.withColumns({"length": length, "beat": F.lit(-2.0)}), "asked")
        able, zero = asked.where("length > 0").drop("length"), asked.where("not length > 0")
        self.possible = (self.rings.agg(F.sum("n")).first()[0] or 0) * asked.count()
        self.computed = 0
        # the block that promises most: nearest centroid, then the ring nearest to the query's angle
        away = F.greatest(F.col("low") - F.col("a"), F.col("a") - F.col("high"), F.lit(0.0))
        ahead = self._ahead(able, True).join(self.rings, "centroid")
        best = ahead.groupBy("query_id").agg(F.min(F.struct(F.when(F.col("n") >= k, 0).otherwise(1).alias("few"), away.alias("away"), "block")).alias("b"))
        tried = materialize(best.select("query_id", F.col("b.block").alias("block")), "tried")
        found = self._compared(tried, able, k)
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id")
        least = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("near").alias("kth"))
        beat = F.coalesce("kth", F.lit(-2.0))
        able = able.drop("beat").join(least, "query_id", "left")
        able = materialize(able.select("query_id", "x", beat.alias("beat"), F.when(F.col("kth").isNull(), 4.0).otherwise(F.acos(F.greatest(F.least("kth", F.lit(1.0)), F.lit(-1.0)))).alias("most")), "asked")
        ahead = self._ahead(able, False).join(able.select("query_id", "most"), "query_id").join(self.rings, "centroid").where(away <= F.col("most") + SLACK)
        pairs = ahead.select("query_id", "block")
        pairs = pairs.join(tried, ["query_id", "block"], "left_anti")
        found = found.unionByName(self._compared(pairs, able.select("query_id", "x", "beat"), k))
        # all of similarity 0.0, so only the k smallest ids can count
        flat = lambda df, blocks: df.select("query_id", F.explode(self._first_ids(blocks, k)).alias("doc_id"), F.lit(0.0).alias("similarity"), F.lit(0.0).alias("near"))
        found = found.unionByName(flat(able.where("beat <= 0"), self.blocks.where(F.col("centroid") == NOWHERE))).unionByName(flat(zero, self.blocks))
        ranked = found.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= k)
        return ranked.select("query_id", "hit_rank", "doc_id", "similarity")

    @property
    def share(self) -> float:
        """Of all pairs of the last search, the share that was computed."""
        return self.computed / self.possible if self.possible else 0.0
