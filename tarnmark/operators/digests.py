"""Which of two tables' rows differ, by digests of ranges of their ids.

Ids fall into leaves by a hash; a leaf's digest is the sum of its rows' hashes, which
does not depend on their order and is added up where the rows lie. Leaves are rolled
up to branches. Only the branches whose digests differ are looked at leaf by leaf,
and only the rows of leaves that differ are joined; all others are equal (two leaves
of different rows share both 64-bit sums with chance 2^-128).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmark.operators.sync import require_store, sync_status
from tarnmark.storage import discard, materialize

#: Rows of a leaf that are aimed at, and leaves of a branch.
LEAF_ROWS, BRANCH = 32, 64


def leaf(column: str, leaves: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(leaves))


def digest_tree(rows: DataFrame, leaves: int) -> DataFrame:
    """(leaf, n, a, b): count and two sums of hashes of the rows (doc_id, content_hash) of each leaf."""
    own = [F.sum(F.xxhash64(F.lit(seed), "doc_id", "content_hash").cast("decimal(20,0)")).alias(name) for seed, name in ((0, "a"), (1, "b"))]
    return rows.groupBy(leaf("doc_id", leaves).alias("leaf")).agg(F.count("*").alias("n"), *own)


def branches(tree: DataFrame) -> DataFrame:
    """The same for branches of BRANCH leaves."""
    up = (F.col("leaf") / BRANCH).cast("long").alias("branch")
    return tree.groupBy(up).agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")])


def _unlike(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    a, b = (x.select(key, F.struct("n", "a", "b").alias(side)) for x, side in ((one, "one"), (other, "other")))
    return a.join(b, key, "full").where(~F.col("one").eqNullSafe(F.col("other"))).select(key)


def differing_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """(leaf) of two digest trees with as many leaves: branches first, then the leaves of those that differ."""
    odd = _unlike(branches(one), branches(other), "branch")
    own = lambda tree: tree.join(odd, (F.col("leaf") / BRANCH).cast("long") == F.col("branch"), "left_semi")
    return _unlike(own(one), own(other), "leaf")


def status_by_digests(docs: DataFrame, store: DataFrame, *, leaves: int | None = None) -> DataFrame:
    """docs with ``status`` as ``sync.sync_status`` gives it; only rows of leaves that differ are joined with the store."""
    require_store(store)
    leaves = leaves or max(BRANCH, -(-docs.count() // LEAF_ROWS))
    trees = [materialize(digest_tree(rows, leaves), "digests") for rows in (docs, store)]
    odd = materialize(differing_leaves(*trees), "leaves")
    discard(*trees)
    inside = lambda rows, how: rows.withColumn("leaf", leaf("doc_id", leaves)).join(odd, "leaf", how).drop("leaf")
    same = inside(docs, "left_anti").withColumn("status", F.lit("skipped"))
    return same.unionByName(sync_status(inside(docs, "left_semi"), inside(store.select("doc_id", "content_hash"), "left_semi")))
