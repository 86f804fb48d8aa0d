"""Breadth-first expansion of many queries at once, 64 to a word.

Queries are numbered by their first start, so that neighbouring ones share words.
A row of a level is (word, node, mask): the queries of the word that reach the node
there first. A hop joins masks with links and ors them for each node, whatever the
number of queries in a word; what was seen before is masked off. So the rows that
are shuffled fall with the queries that share a word and a node. Masks are combined
before they are shuffled, and the links are a written table, so Spark can split the
rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnmark.operators.links import adjacency
from tarnmark.storage import discard, materialize

#: Queries of a word.
BITS = 64


def numbered(starts: DataFrame) -> DataFrame:
    """(query_id, word, bit) of each query, in the order of its smallest start.

    Numbers come from ranges of sorted queries and the counts of the ranges before,
    not from one task that sorts all.
    """
    first = starts.groupBy("query_id").agg(F.min("id").alias("first")).orderBy("first", "query_id")
    placed = materialize(first.select("query_id", F.monotonically_increasing_id().alias("n")), "queries")
    part, within = F.shiftright("n", 33), F.col("n").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = counts.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).drop("rows")  # a row a partition
    number = F.col("before") + F.col("within")
    rows = placed.select("query_id", part.alias("part"), within.alias("within")).join(before, "part")
    out = materialize(rows.select("query_id", (number / BITS).cast("long").alias("word"), (number % BITS).cast("int").alias("bit")), "words")
    discard(placed)
    return out


def expand_bits(starts: DataFrame, edges: DataFrame, hops: int = 1, direction: str = "out") -> DataFrame:
    """(query_id, id, distance), as ``graph.expand`` gives them."""
    if hops < 0:
        raise ValueError(f"hops must not be negative, got {hops}")
    starts = starts.select("query_id", "id").distinct()
    words = numbered(starts)
    mask = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")
    steps = materialize(adjacency(edges, direction), "adjacency")
    level = materialize(starts.join(words, "query_id").groupBy("word", "id").agg(mask), "level")
    seen, levels = level, []
    for hop in range(1, hops + 1):
        ahead = level.join(steps, level["id"] == steps["src"]).groupBy("word", F.col("dst").alias("id")).agg(F.bit_or("mask").alias("mask"))
        known = seen.withColumnRenamed("mask", "known")
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        level = materialize(ahead.join(known, ["word", "id"], "left").select("word", "id", fresh.alias("mask")).where("mask <> 0"), "level")
        if level.isEmpty():
            break
        levels.append(level.withColumn("distance", F.lit(hop)))
        if hop < hops:
            both = seen.unionByName(level).groupBy("word", "id").agg(F.bit_or("mask").alias("mask"))
            last, seen = seen, materialize(both, "seen")
            if hop > 1:
                discard(last)
    out = None
    for rows in levels:
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return starts.withColumn("distance", F.lit(0)).where("distance > 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit("mask", b) == 1)
    each = out.select("word", "id", "distance", F.explode(bits).alias("bit"))
    return each.join(words, ["word", "bit"]).select("query_id", "id", "distance")
