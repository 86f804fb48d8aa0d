"""Centroid clustering with block-norm screening and exact integer distances.

A vector is kept as 64 integers and, for each segment of eight of them, its
mean and the norm of what remains. These small summaries of vectors and
centroids bound a distance from below: within a segment the means differ by a
known amount, and by Cauchy and Schwarz the remainders differ by at least the
difference of their norms. The centroid with the least bound gets an exact
distance first; of the others only those whose bound does not exceed it get one
(integers, so ties are ties). The summaries of the vectors are computed once and
written with them; every round reads that table.

A round adds up each task's members of a centroid as integers, so the shuffle
carries tasks x centroids rows and the driver sees the sums of 16 centroids.

Defined results: vectors that are null, of another length than 64, or hold a
null or non-finite component are left out, and so are those with a component
beyond +-LARGEST / 64, whose squared distances a long could not hold; rows that
repeat a vec_id are clustered each (equal hashes start in the order of their
components); an inertia that no long can hold is null; a row without vec_id has the hash of an empty id; fewer than 16
vectors start fewer centroids; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import materialize, per_batch, table
from tarnmark.storage import discard

#: Components, components of a segment, units of one, centroids, rounds, and the seed of the start.
DIMS, SEGMENT, UNITS, CENTROIDS, ROUNDS, SEED = 64, 8, 64, 16, 3, "1"
#: Components beyond this in units are refused: 64 squared differences of twice as much still fit a long.
LARGEST = 1 << 27
#: Vectors that are compared at once within a batch.
_BLOCK = 4096
STORED = "vec_id long, v array<int>, means array<double>, norms array<double>"


def summaries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, norms of the remainders) of the segments of integer vectors."""
    parts = v.reshape(len(v), v.shape[1] // SEGMENT, SEGMENT).astype(np.float64)
    means = parts.mean(axis=2)
    return means, np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))


def lower_bounds(means: np.ndarray, norms: np.ndarray, c_means: np.ndarray, c_norms: np.ndarray) -> np.ndarray:
    """Of each vector and centroid, a squared distance that theirs is not below (rounding taken off)."""
    out = np.zeros((len(means), len(c_means)))
    for s in range(means.shape[1]):
        out += SEGMENT * (means[:, s, None] - c_means[None, :, s]) ** 2 + (norms[:, s, None] - c_norms[None, :, s]) ** 2
    return out * (1 - 1e-9) - 1


class Screen:
    """Centroids with their summaries; finds the nearest of each vector and counts the exact distances it took."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.exact = centroids.astype(np.int64), 0
        self.means, self.norms = summaries(self.centroids)

    def _distances(self, v: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        self.exact += len(rows)
        gap = v[rows] - self.centroids[which]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, v: np.ndarray, means: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance); of equally near ones the smallest number."""
        n = len(v)
        bounds = lower_bounds(means, norms, self.means, self.norms)
        first, every = bounds.argmin(axis=1), np.arange(n)
        found = np.full(bounds.shape, np.iinfo(np.int64).max)
        found[every, first] = best = self._distances(v, every, first)
        open_ = bounds <= best[:, None]
        open_[every, first] = False
        rows, which = np.nonzero(open_)
        found[rows, which] = self._distances(v, rows, which)
        chosen = found.argmin(axis=1)
        return chosen, found[every, chosen]


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def stored(embeddings: DataFrame) -> DataFrame:
    """The vectors that are kept, in units, with the summaries of their segments; a written table."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == DIMS) & F.forall(x, lambda y: F.coalesce(F.abs(y) <= LARGEST / UNITS, F.lit(False)) & ~F.isnan(y))

    def make() -> Callable:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = np.floor(_matrix(batch.column(1), np.float64, DIMS) * UNITS).astype(np.int32)
            means, norms = summaries(v)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]) for a in (v, means, norms)]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column(0), *[a.cast(k) for a, k in zip(lists, kinds)]], names=["vec_id", "v", "means", "norms"])

        return step

    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(good, F.lit(False)))
    return materialize(kept.mapInArrow(per_batch(make), STORED), "vectors")


def start(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The vectors whose ids have the k smallest hashes, in the order of the hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], dtype=np.int64).reshape(-1, DIMS)


def _blocks(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, _BLOCK):
        part = batch.slice(at, _BLOCK)
        v = _matrix(part.column("v"), np.int64, DIMS)
        yield part.column("vec_id"), v, *(_matrix(part.column(n), np.float64, DIMS // SEGMENT) for n in ("means", "norms"))


def moved(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(centroids after one round, exact distances it took): means of the members, rounded down; empty ones stay."""

    def run(batches):
        screen = Screen(centroids)
        sums, counts = np.zeros((len(centroids), DIMS), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v, means, norms in _blocks(batch):
                chosen, _ = screen.nearest(v, means, norms)
                np.add.at(sums, chosen, v)
                counts += np.bincount(chosen, minlength=len(counts))
        some = np.flatnonzero(counts)
        exact = np.zeros(len(some), np.int64)
        exact[:1] = screen.exact
        columns = [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array(exact)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums", "exact"])

    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<long>, exact long")
    total = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(DIMS)]
    out, exact = centroids.copy(), 0
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), *total).collect():  # a row a centroid
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(DIMS)]
        exact += r.exact
    return out, exact


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every stored vector."""

    def make() -> Callable:
        screen = Screen(centroids)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(ids, *screen.nearest(v, means, norms)) for ids, v, means, norms in _blocks(batch)]
            ids, chosen, distance = zip(*found)
            columns = [pa.concat_arrays(ids), pa.array(np.concatenate(chosen).astype(np.int32)), pa.array(np.concatenate(distance))]
            return pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

        return step

    return vectors.mapInArrow(per_batch(make), "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) after ``rounds`` rounds from ``k`` vectors (vec_id, embedding)."""
    if k < 1 or rounds < 0:
        raise ValueError(f"k must be at least 1 and rounds at least 0, got {k} and {rounds}")
    vectors = stored(embeddings)
    centroids = start(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids, _ = moved(vectors, centroids)
    out = materialize(assigned(vectors, centroids), "assigned")
    discard(vectors)
    return out, centroids


def clusters_with_inertia(embeddings: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(embeddings, **settings)
    own = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    fits = lambda n: n if n < 1 << 63 else None
    facts = [(i, fits(own[i]), fits(sum(own.values())), digest[i]) for i in sorted(own)]
    known = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def cluster_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13: every vector of the embeddings."""
    return clusters_with_inertia(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same in SQL: components of every vector as rows, rounds as a chain of named queries."""
    steps = [
        f"""e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({UNITS} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMS}
  AND list_count(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM e ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT vec_id, v, d, k FROM (SELECT vec_id, e.v, c.k, list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d "
            f"FROM e, c{n} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"
        )
        if n < ROUNDS:
            steps.append(
                f"m{n} AS (SELECT k, i, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT k, unnest(v) AS x, unnest(range({DIMS})) AS i FROM a{n}) GROUP BY k, i), "
                f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS v FROM m{n} GROUP BY k) m ON m.k = c.k)"
            )
    last = ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.k::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON c.k = a.k"""
    )


ORACLE = _oracle()
