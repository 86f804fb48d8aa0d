"""Resolution of links, and views of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmark.functions.text import casefold
from tarnmark.storage import discard, materialize


def wiki_keys(concepts: DataFrame) -> DataFrame:
    """(id, key): the lookup keys of each concept, which are its id, its last segment, the title and the aliases, case-folded."""
    title = F.when(F.col("title") != "", F.col("title"))
    names = F.concat(F.array("id", F.element_at(F.split("id", "/"), -1), title), F.coalesce("aliases", F.array().cast("array<string>")))
    return concepts.select("id", F.explode(names).alias("name")).where("name is not null").select("id", casefold(F.col("name")).alias("key")).distinct()


def wiki_index(concepts: DataFrame) -> DataFrame:
    """(key, n, concept_id): each lookup key, how many concepts have it, and the one if it is one."""
    grouped = wiki_keys(concepts).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("concept_id"))
    return grouped.select("key", "n", F.when(F.col("n") == 1, F.col("concept_id")).alias("concept_id"))


def resolve(occurrences: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges with ``resolved`` and ``ambiguous``.

    Path links resolve if their target is a concept. Wikilinks resolve to the
    one concept with their key; with several they are ambiguous and keep the key.
    Both sides are joined on equality with at most one match, so nothing fans out.
    The index is a written table when it is joined, so that Spark can split a key
    that many notes use; the edges are a written table too.
    """
    known = concepts.select(F.col("id").alias("known_id")).distinct()
    index = materialize(wiki_index(concepts).select(F.col("key"), "n", "concept_id"), "wiki-index")
    is_wiki = F.col("link_kind") == "wiki"
    joined = occurrences.join(known, ~is_wiki & (F.col("target_id") == F.col("known_id")), "left")
    joined = joined.join(index, is_wiki & (F.col("target_id") == F.col("key")), "left")
    edges = joined.select(
        "source_id",
        "edge_pos",
        F.coalesce("concept_id", "target_id").alias("target_id"),
        "anchor_text",
        (F.col("known_id").isNotNull() | F.col("concept_id").isNotNull()).alias("resolved"),
        "link_kind",
        F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"),
    )
    edges = materialize(edges, "edges")
    discard(index)
    return edges


def links_from(edges: DataFrame, concept_id: str) -> DataFrame:
    return edges.where(F.col("source_id") == concept_id).orderBy("edge_pos")


def backlinks(edges: DataFrame, concept_id: str) -> DataFrame:
    return edges.where(F.col("resolved") & (F.col("target_id") == concept_id)).orderBy("source_id", "edge_pos")


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(src, dst) of distinct resolved links, followed ``out``, ``in`` or ``both`` ways."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be 'out', 'in' or 'both', got {direction!r}")
    out = edges.where("resolved").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def synthesized_index(concepts: DataFrame, title: str = "Index") -> DataFrame:
    """An index of all concepts in id order, as one row (title, description, body, concept_ids)."""
    label = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("id"))
    line = F.concat(F.lit("- ["), label, F.lit("](/"), F.col("id"), F.lit(".md)"))
    listed = concepts.agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("all"))
    return listed.select(
        F.lit(title).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.concat(F.lit(f"# {title}\n\n"), F.array_join("all.line", "\n"), F.when(F.size("all") > 0, F.lit("\n")).otherwise(F.lit(""))).alias("body"),
        F.col("all.id").alias("concept_ids"),
    )
