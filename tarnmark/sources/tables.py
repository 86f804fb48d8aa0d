"""Relational tables seen as collections of linked notes.

Each adapter is a plain projection, so the links it makes have closed forms that
SQL can state without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.operators.parsing import concepts_of, occurrences, parse_notes
from tarnmark.operators.links import resolve
from tarnmark.storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_concepts(documents: DataFrame) -> DataFrame:
    """Documents as concepts: id docs/source/number, type the language, tags source and language."""
    number = F.col("doc_id").cast("string")
    text = F.lit(None).cast("string")
    return documents.select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), number).alias("id"), F.concat(F.lit("/kb/docs/"), "source", F.lit("/"), number, F.lit(".md")).alias("path"),
        F.col("lang").alias("type"), F.concat(F.lit("Doc "), number).alias("title"), text.alias("description"), text.alias("resource"),
        F.array("source", "lang").alias("tags"), F.array().cast("array<string>").alias("aliases"), text.alias("ts_iso"), F.col("text").alias("body"),
    )


def _doc(number: Column) -> Column:
    return F.concat(F.lit("doc"), number.cast("string"))


def generated_notes(documents: DataFrame, n: int | None = None) -> DataFrame:
    """Each document as raw Markdown (id, path, raw) with links in closed form.

    Of n documents, number i links to 7i+3 and 3i+1 (modulo n, as path links),
    to n+i (missing), by title to 13i+5 (modulo n, as wikilink) and to an alias
    that every tenth document has. Links in code, images and embeds stand there
    to be ignored. Of each fifty, three are broken in their metadata.
    """
    n = documents.count() if n is None else n
    i = F.col("doc_id")
    d = i.cast("string")
    shared = F.when(i % 10 == 0, ", Shared").otherwise("")
    meta = F.concat(
        F.when(i % 50 == 7, "kind: ").otherwise("type: "), "lang", F.lit("\ntitle: Doc "), d, F.lit("\ntags: ["), "source", F.lit(", "), "lang",
        F.lit("]\naliases: [Alias "), d, shared, F.lit("]\ntimestamp: 2025-11-03T21:15:00\nrank: "), (i % 7).cast("string"), F.lit("\n"),
    )
    body = F.concat(
        F.lit("# Doc "), d, F.lit("\n\nSee [next]("), _doc((7 * i + 3) % n), F.lit(".md) and [missing]("), _doc(i + n), F.lit('.md "gone").\n'),
        F.lit("Also [[Doc "), ((13 * i + 5) % n).cast("string"), F.lit("]], [[Shared|a shared name]], ![img](pic.md) and ![[Doc 1]].\n\n```\n[hidden](doc0.md)\n```\n"),
        F.lit("[far](https://example.com/x.md) [part](#here) [abs](/notes/"), _doc((3 * i + 1) % n), F.lit(".md#part)\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"),
    )
    raw = F.concat(F.when(i % 50 == 23, "").otherwise("---\n"), meta, F.when(i % 50 == 41, "").otherwise("---\n"), body)
    name = F.concat(F.lit("notes/"), _doc(i))
    return documents.select(name.alias("id"), F.concat(name, F.lit(".md")).alias("path"), raw.alias("raw"))


def generated_bundle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, edges, parsed) of the generated notes."""
    parsed = materialize(parse_notes(generated_notes(table(spark, sf_dir, "documents"))), "parsed")
    concepts = concepts_of(parsed)
    return concepts, resolve(occurrences(concepts), concepts), parsed


def key_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as resolved edges, child to parent: orders, customers, suppliers, nations, regions."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, key, b, other: df.select(
        F.concat(F.lit(f"{a}/"), F.col(key).cast("string")).alias("source_id"), F.lit(0).alias("edge_pos"),
        F.concat(F.lit(f"{b}/"), F.col(other).cast("string")).alias("target_id"), F.lit(True).alias("resolved"),
    )
    return (
        edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey")
        .unionByName(edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(edge(t("orders"), "order", "o_orderkey", "customer", "o_custkey"))
    )


def turn_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as an edge to the next one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda turn: F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    before = c.select("conv_id", F.col("turn").alias("last"), (F.col("turn") + 1).alias("turn"))
    return c.join(before, ["conv_id", "turn"]).select(
        name(F.col("last")).alias("source_id"), F.lit(0).alias("edge_pos"), name(F.col("turn")).alias("target_id"), F.lit(True).alias("resolved")
    )
