"""A loaded collection of notes: a handle of written tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmark.errors import BundleInvalid, ConceptNotFound
from tarnmark.functions.markdown import Invalid
from tarnmark.operators import graph, search
from tarnmark.operators.links import backlinks, links_from, resolve, synthesized_index
from tarnmark.operators.parsing import concepts_of, index_row, occurrences, parse_notes
from tarnmark.operators.search_index import SearchIndex
from tarnmark.shipping import ship
from tarnmark.sources.files import checked_root, decode
from tarnmark.sources.tree import read_tree
from tarnmark.storage import discard, materialize

INDEX = "title string, description string, body string, concept_ids array<string>"


class Bundle:
    """concepts, edges, skipped and index as DataFrames; nothing changes after loading."""

    def __init__(self, root: str, concepts: DataFrame, edges: DataFrame, skipped: DataFrame, index: DataFrame):
        self.root, self.concepts, self.edges, self.skipped, self._index = root, concepts, edges, skipped, index
        self.search_index: SearchIndex | None = None

    @classmethod
    def of_notes(cls, notes: DataFrame, root: str, index: DataFrame | None = None) -> "Bundle":
        """From rows (id, path, raw[, reason]); each note is parsed once, and of rows with one id the last in path order stays."""
        parsed = materialize(parse_notes(notes), "parsed")
        if not parsed.groupBy("id").count().where("count > 1").isEmpty():
            last = Window.partitionBy("id").orderBy(F.desc("path"))
            again, parsed = parsed, materialize(parsed.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n"), "parsed")
            discard(again)
        concepts = concepts_of(parsed)
        edges = resolve(occurrences(concepts), concepts)
        below = F.when(F.startswith("path", F.lit(root + "/")), F.substring("path", len(root) + 2, 1 << 30)).otherwise(F.col("path"))
        skipped = parsed.where("reason is not null").select(below.alias("path"), "reason")
        return cls(root, concepts.drop("links"), edges, skipped, index if index is not None else synthesized_index(concepts))

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, on_error: str = "raise") -> "Bundle":
        """From a directory tree. ``raise`` reports all bad files in one error; ``skip`` leaves them out, as rows of ``skipped``."""
        if on_error not in ("raise", "skip"):
            raise ValueError(f"on_error must be 'raise' or 'skip', got {on_error!r}")
        root = checked_root(str(path))
        bundle = cls.of_notes(read_tree(ship(spark), root), root)
        index, reason = cls._read_index(root)
        if reason:
            bundle.skipped = bundle.skipped.unionByName(spark.createDataFrame([("index.md", reason)], "path string, reason string"))
        if on_error == "raise":
            failed = {r.path: r.reason for r in bundle.skipped.collect()}  # they are all told in the error
            if failed:
                raise BundleInvalid(failed)
        if index is not None:
            bundle._index = spark.createDataFrame([index], INDEX)
        if bundle.concepts.isEmpty():
            warnings.warn(f"bundle at {root} contains no concept files", UserWarning, stacklevel=2)
        return bundle

    @staticmethod
    def _read_index(root: str) -> tuple[tuple | None, str | None]:
        """(row, None) of the root index, (None, None) without one, (None, reason) if it is bad."""
        path = f"{root.rstrip('/')}/index.md"
        text, reason = decode(path)
        if reason:
            absent = "No such file" in reason or "does not exist" in reason or "not found" in reason.lower()
            return None, None if absent else f"index could not be read: {reason}"
        try:
            title, description, ids = index_row(text)
        except Invalid as e:
            return None, str(e)
        return (title, description, text, ids), None

    @property
    def concept_count(self) -> int:
        return self.concepts.count()

    def index(self) -> DataFrame:
        return self._index

    def all_concepts(self) -> DataFrame:
        return self.concepts.orderBy("id")

    def get(self, concept_id: str):
        """The concept as a row; ConceptNotFound if there is none."""
        row = self.concepts.where(F.col("id") == concept_id).first()
        if row is None:
            raise ConceptNotFound(concept_id)
        return row

    def _known(self, concept_id: str) -> None:
        if self.concepts.where(F.col("id") == concept_id).select("id").first() is None:
            raise ConceptNotFound(concept_id)

    def build_search_index(self, path: str | None = None) -> SearchIndex:
        """Write an index (to ``path``, or a folder of its own) that searches use from now on."""
        self.search_index = SearchIndex.build(self.concepts, path)
        return self.search_index

    def search(self, query: str, top_k: int = 5) -> DataFrame:
        if self.search_index is not None:
            return self.search_index.search_one(query, top_k)
        return search.search_one(self.concepts, query, top_k)

    def search_many(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """(query_id, rank, id, score) of queries (query_id, query)."""
        if self.search_index is not None:
            return self.search_index.search(queries, top_k)
        return search.search(self.concepts, queries, top_k)

    def links_from(self, concept_id: str) -> DataFrame:
        self._known(concept_id)
        return links_from(self.edges, concept_id)

    def backlinks(self, concept_id: str) -> DataFrame:
        self._known(concept_id)
        return backlinks(self.edges, concept_id)

    def neighbors(self, concept_id: str, hops: int = 1, direction: str = "out") -> DataFrame:
        self._known(concept_id)
        return graph.neighbors(concept_id, self.edges, hops, direction)
