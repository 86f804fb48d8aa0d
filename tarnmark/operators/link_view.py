"""Resolved links that are kept up to date as notes come, change and go.

Three stores of deltas hold the view: the notes with their keys and links, the lookup
keys as a multiset of (key, concept), and the resolved edges. A path link looks up
``p:`` and an id, a wikilink ``w:`` and a case-folded name; a concept offers the keys of
both kinds. An update takes back what the touched notes offered and linked before, adds
what they do now, and resolves anew just their own edges and those that look up a key
whose concepts have changed. Keys and edges are bucketed by the key, so only the
buckets of such keys are read.

Keys are written first and notes last. An update that fails in between and is repeated
under its number finds the notes as they were, takes the same differences, and writes
what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.operators.delta_store import BUCKETS, DeltaStore
from tarnmark.operators.links import wiki_keys
from tarnmark.storage import discard, materialize

_LINK = "struct<edge_pos: int, target_id: string, anchor_text: string, link_kind: string>"
EDGE = ["source_id", "edge_pos", "target_id", "anchor_text", "resolved", "link_kind", "ambiguous"]


def _offered(notes: DataFrame) -> DataFrame:
    """(row, key, id) of the keys of notes (id, keys)."""
    rows = notes.select("id", F.explode("keys").alias("key"))
    return rows.select(F.concat_ws("\0", "key", "id").alias("row"), "key", "id")


def _linked(notes: DataFrame) -> DataFrame:
    """(row, wanted, source_id, edge_pos, given, anchor_text, link_kind) of the links of notes (id, links)."""
    rows = notes.select(F.col("id").alias("source_id"), F.inline("links")).withColumnRenamed("target_id", "given")
    wanted = F.concat(F.when(F.col("link_kind") == "wiki", "w:").otherwise("p:"), "given")
    rows = rows.withColumn("wanted", wanted)
    return rows.withColumn("row", F.concat_ws("\0", "source_id", F.col("edge_pos").cast("string"), "wanted"))


class LinkView:
    """The edges of a changing collection, as ``links.resolve`` over all of it would give them."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = BUCKETS, compact_after: int = 8):
        store = lambda name, schema, key, by=None: DeltaStore(spark, f"{path.rstrip('/')}/{name}", buckets=buckets, compact_after=compact_after, schema=schema, key=key, by=by)
        self.notes = store("notes", f"id string, keys array<string>, links array<{_LINK}>", "id")
        self.keys = store("keys", "row string, key string, id string", "row", "key")
        self.links = store(
            "edges", "row string, wanted string, source_id string, edge_pos int, given string, target_id string, anchor_text string, resolved boolean, link_kind string, ambiguous boolean", "row", "wanted"
        )
        self.resolved = 0

    def edges(self) -> DataFrame:
        return self.links.read(columns=EDGE).select(EDGE)

    def update(self, concepts: DataFrame, gone: DataFrame | None = None, *, batch: int | None = None) -> bool:
        """Put concepts (id, title, aliases, links) in, take ids away; False if this batch was applied before."""
        done = self.notes.state()["batch"]
        if batch is not None and done is not None and batch <= done:
            return False
        names = wiki_keys(concepts).groupBy("id").agg(F.collect_list(F.concat(F.lit("w:"), "key")).alias("names"))
        path = F.concat(F.lit("p:"), "id")
        own = F.array_sort(F.concat(F.array(path), F.coalesce("names", F.array().cast("array<string>"))))
        new = materialize(concepts.join(names, "id", "left").select("id", own.alias("keys"), F.col("links").cast(f"array<{_LINK}>").alias("links")), "new")
        ids = new.select("id")
        if gone is not None:
            ids = ids.unionByName(gone.select("id")).distinct()
        ids = materialize(ids, "ids")
        old = materialize(self.notes.read(buckets=self.notes.buckets_of(ids)).join(ids, "id", "left_semi"), "old")
        # the keys that concepts have begun or ceased to offer
        offers, offered = _offered(new), _offered(old)
        added, taken = offers.join(offered, "row", "left_anti"), offered.join(offers, "row", "left_anti")
        touched = materialize(added.select("key").unionByName(taken.select("key")).distinct(), "touched")
        self.keys.write(added, batch=batch, gone=taken)
        # edges of the touched notes, and those that look up a touched key
        given = ["row", "wanted", "source_id", "edge_pos", "given", "anchor_text", "link_kind"]
        by_key = touched.withColumnRenamed("key", "wanted")
        others = self.links.read(columns=given, buckets=self.links.buckets_of(by_key)).join(by_key, "wanted", "left_semi").join(ids, F.col("source_id") == F.col("id"), "left_anti")
        again = materialize(_linked(new).select(given).unionByName(others.select(given)), "again")
        self.resolved = again.count()
        wanted = again.select("wanted").distinct()
        found = self.keys.read(buckets=self.keys.buckets_of(wanted.withColumnRenamed("wanted", "key"))).join(wanted, F.col("key") == F.col("wanted"), "left_semi")
        found = materialize(found.groupBy(F.col("key").alias("wanted")).agg(F.count("*").alias("n"), F.min("id").alias("one")), "found")
        wiki, n = F.col("link_kind") == "wiki", F.coalesce("n", F.lit(0))
        put = again.join(found, "wanted", "left").select(
            *given, F.when(wiki & (n == 1), F.col("one")).otherwise(F.col("given")).alias("target_id"),
            F.when(wiki, n == 1).otherwise(n > 0).alias("resolved"), (wiki & (n > 1)).alias("ambiguous"),
        )
        lost = _linked(old).select("row", "wanted").join(again.select("row"), "row", "left_anti")
        self.links.write(put, batch=batch, gone=lost)
        away = ids.join(new.select("id"), "id", "left_anti")
        self.notes.write(new, batch=batch, gone=away)
        discard(new, ids, old, touched, again, found)
        return True
