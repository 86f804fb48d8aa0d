"""Connected components of an edge list that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmark.llm.common import materialize
from tarnmark.storage import discard


def _around(edges: DataFrame) -> DataFrame:
    """(hi, least, open) of every node hi: the least of it and its neighbours, and whether it is neither a root nor hangs on one node only.

    A table of its own, so that both sides of a join with it are plain and Spark can split a hub's rows.
    """
    least = F.least(F.col("hi"), F.min("lo"))
    around = _both(edges).groupBy("hi").agg(least.alias("least"), ((F.min("lo") < F.col("hi")) & (F.min("lo") < F.max("lo"))).alias("open"))
    return materialize(around, "around")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))


def _large_star(edges: DataFrame, around: DataFrame) -> DataFrame:
    return _both(edges).join(around, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("hi").agg(F.min("lo").alias("least")), "least")
    across = edges.join(least, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    stars = materialize(across.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct(), "edges")
    discard(least)
    return stars


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Alternates large-star and small-star steps until the edges are stars, which
    the first step of a round sees: edges that are stars already cost one
    written table, a round three more. The number of rounds grows with the
    logarithm of the longest path. Null ends, loops and repeated edges are
    dropped. The edges are read more than once, so they should be written.
    """
    now = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    around = _around(now)
    while not around.where("open").isEmpty():
        last, now = now, _small_star(_large_star(now, around))
        discard(last, around)
        around = _around(now)
    discard(now)
    return around.select(F.col("hi").alias("node"), F.col("least").alias("component"))
