"""Nearest vectors, and retrieval that follows links from the nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarnmark.functions.text import tokens
from tarnmark.operators.graph import expand
from tarnmark.operators.search import documents_of

#: Query vectors that one pass over the store takes; more come in further passes. Vectors of the store that a task multiplies at once.
BLOCK, SLICE = 2048, 512


def hashed_embedding(column: Column, dims: int = 64) -> Column:
    """A deterministic embedding without a model: tokens hashed into buckets, counts scaled to length one (zero without tokens)."""
    if dims & (dims - 1) or not 0 < dims <= 65536:
        raise ValueError(f"dims must be a power of two up to 65536, got {dims}")
    buckets = F.transform(tokens(column), lambda t: F.conv(F.right(F.sha2(t, 256), F.lit(4)), 16, 10).cast("int") % dims)
    counts = F.transform(F.array(buckets), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    scaled = F.transform(counts, lambda c: F.transform(F.array(norm(c)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
    return F.get(F.flatten(scaled), F.lit(0))


def _matrix(column: pa.Array) -> np.ndarray:
    if len(column.value_lengths().unique()) > 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _own_best(shipped, k: int):
    """Rows (id, vector) to the task's own best k of each query (query_id, doc_id, similarity, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, norms, kinds = shipped.value
        best: list[list[tuple]] = [[] for _ in names]  # (minus rounded similarity, id, similarity)
        least = np.full(len(names), -np.inf)  # the k-th of each query so far
        for at, batch in ((at, batch) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            part = batch.slice(at, SLICE)
            ids, x = part.column(0).to_pylist(), _matrix(part.column(1))
            size = np.linalg.norm(x, axis=1)[:, None] * norms[None, :]
            sim = np.divide(x @ q.T, size, out=np.zeros_like(size), where=size > 0)
            near = np.round(sim, 12, out=size)
            able = np.flatnonzero((near >= least).any(axis=0))
            n = min(k, len(ids))
            edge = np.maximum(np.partition(near[:, able], len(ids) - n, axis=0)[len(ids) - n], least[able])
            cols, rows = np.nonzero((near[:, able] >= edge).T)  # ties at the edge included
            bounds = np.searchsorted(cols, np.arange(len(able) + 1))
            for place, c in enumerate(able.tolist()):
                here = rows[bounds[place] : bounds[place + 1]]
                own = best[c]
                own += zip((-near[here, c]).tolist(), [ids[r] for r in here], sim[here, c].tolist())
                own.sort(key=lambda x: x[:2])
                del own[k:]
                if len(own) == k:
                    least[c] = -own[-1][0]
        flat = [(name, i, s, -r) for name, own in zip(names, best) for r, i, s in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), kinds)], names=["query_id", "doc_id", "similarity", "near"])

    return run


def nearest(store: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hit_rank, doc_id, similarity): cosine, ties by doc_id, zero vectors at 0.0.

    store: doc_id, embedding. queries: query_id, embedding; a stated set that is
    sent to the tasks in blocks of BLOCK, each a pass over the store. Similarities
    are compared to twelve digits. Each task keeps its own best k of each query
    over all its batches, so the shuffle carries tasks x queries x k rows,
    whatever the size of the store. A task holds SLICE x BLOCK similarities.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    spark = store.sparkSession
    asked_type, doc_type = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(store.schema["doc_id"].dataType)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>")).where("embedding is not null").orderBy("query_id").collect()
    found, kind, key = [], queries.schema["query_id"].dataType.simpleString(), store.schema["doc_id"].dataType.simpleString()
    for at in range(0, len(asked), BLOCK):
        block = asked[at : at + BLOCK]
        names, q = [r.query_id for r in block], np.array([r.embedding for r in block], dtype=np.float64)
        norms = np.linalg.norm(q, axis=1)
        shipped = spark.sparkContext.broadcast((names, q, norms, (asked_type, doc_type, pa.float64(), pa.float64())))  # BLOCK vectors at most
        rows = store.select("doc_id", F.col("embedding").cast("array<double>")).where("embedding is not null")
        found.append(rows.mapInArrow(_own_best(shipped, k), f"query_id {kind}, doc_id {key}, similarity double, near double"))
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, hit_rank int, doc_id {key}, similarity double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id")
    return out.withColumn("hit_rank", F.row_number().over(best)).where(F.col("hit_rank") <= k).select("query_id", "hit_rank", "doc_id", "similarity")


def valid_hits(hits: DataFrame, concepts: DataFrame, bundle_root: str) -> DataFrame:
    """Hits (query_id, hit_rank, concept_id, bundle_root) that name a concept of this bundle; the first of repeats."""
    own = hits.where(F.col("concept_id").isNotNull() & (F.col("bundle_root").isNull() | (F.col("bundle_root") == bundle_root)))
    own = own.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    first = own.groupBy("query_id", "concept_id").agg(F.min("hit_rank").alias("hit_rank"))
    return first.select("query_id", "hit_rank", "concept_id")


def graph_retrieve(hits: DataFrame, concepts: DataFrame, edges: DataFrame, bundle_root: str, *, expand_hops: int = 1, direction: str = "out") -> DataFrame:
    """(query_id, rank, concept_id, distance, page_content, metadata).

    Entry hits first, in their order; then what links reach from them, by
    distance from the nearest entry and id. Documents come from the bundle.
    """
    entries = valid_hits(hits, concepts, bundle_root)
    reached = expand(entries.select("query_id", F.col("concept_id").alias("id")), edges, expand_hops, direction)
    ordered = entries.select("query_id", "concept_id", F.lit(0).alias("distance"), "hit_rank").unionByName(
        reached.select("query_id", F.col("id").alias("concept_id"), "distance", F.lit(None).cast("int").alias("hit_rank"))
    )
    place = Window.partitionBy("query_id").orderBy("distance", "hit_rank", "concept_id")
    ranked = ordered.withColumn("rank", F.row_number().over(place))
    return ranked.join(documents_of(concepts, bundle_root), "concept_id").select("query_id", "rank", "concept_id", "distance", "page_content", "metadata")
