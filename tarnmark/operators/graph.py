"""Bounded breadth-first expansion of many starting sets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmark.operators.links import adjacency
from tarnmark.storage import materialize


def expand(starts: DataFrame, edges: DataFrame, hops: int = 1, direction: str = "out") -> DataFrame:
    """(query_id, id, distance) of what is reachable from the starts (query_id, id) of each query.

    Distances count from the nearest start; starts never reappear. One equi-join
    and one anti-join for each hop; every level is a written table, so plans
    stay short, and an empty level ends the loop.
    """
    if hops < 0:
        raise ValueError(f"hops must not be negative, got {hops}")
    steps = adjacency(edges, direction)
    level = starts.select("query_id", "id").distinct().withColumn("distance", F.lit(0))
    if hops == 0:
        return level.where("distance > 0")
    if hops > 1:
        steps, level = materialize(steps, "adjacency"), materialize(level, "level")
    seen = level
    for hop in range(1, hops + 1):
        ahead = level.join(steps, level["id"] == steps["src"]).select("query_id", F.col("dst").alias("id")).distinct()
        level = ahead.join(seen, ["query_id", "id"], "left_anti").withColumn("distance", F.lit(hop))
        if hop < hops:
            level = materialize(level, "level")
            if level.isEmpty():
                break
        seen = seen.unionByName(level)
    return seen.where("distance > 0")


def neighbors(concept_id: str, edges: DataFrame, hops: int = 1, direction: str = "out") -> DataFrame:
    """(id, distance) around one concept, nearest first, then by id."""
    start = edges.sparkSession.createDataFrame([("q", concept_id)], "query_id string, id string")
    return expand(start, edges, hops, direction).select("id", "distance").orderBy("distance", "id")
