"""Raw notes to typed concepts, skipped files and link occurrences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, IntegerType, StringType, StructField, StructType, TimestampNTZType,
)

from tarnmark.functions import link_text
from tarnmark.functions.markdown import Invalid, index_heading, links, metadata_row

_TEXT, _LIST = StringType(), ArrayType(StringType())
LINK = StructType(
    [StructField("edge_pos", IntegerType())] + [StructField(n, _TEXT) for n in ("target_id", "anchor_text", "link_kind")]
)
PARSED = StructType(
    [StructField(n, _TEXT) for n in ("id", "path", "raw", "reason", "type", "title", "description", "resource")]
    + [StructField("tags", _LIST), StructField("aliases", _LIST), StructField("ts_iso", _TEXT), StructField("ts_ntz", TimestampNTZType())]
    + [StructField("ts_offset_s", IntegerType()), StructField("extra", _TEXT), StructField("body", _TEXT)]
    + [StructField("outbound_links", _LIST), StructField("links", ArrayType(LINK))]
)
#: What is read from the metadata.
_READ = ("reason", "type", "title", "description", "resource", "tags", "aliases", "ts_iso", "ts_ntz", "ts_offset_s", "extra")


def parse_notes(notes: DataFrame) -> DataFrame:
    """Parse rows (id, path, raw[, reason]); a given reason skips parsing.

    A bad note gives a row with ``reason`` set, never a failed task. Python reads
    the metadata only: bodies are cut and their links found in the JVM. A null
    ``raw`` is an empty note. A target named in a reason is quoted as in Python,
    but for characters that do not print, which stay as they are.
    """
    if "reason" not in notes.columns:
        notes = notes.withColumn("reason", F.lit(None).cast("string"))
    kind = StructType([f for f in PARSED if f.name in _READ])
    schema = pa.struct(list(to_arrow_schema(kind)))

    @F.arrow_udf(kind)
    def read(sources: pa.Array) -> pa.Array:
        return pa.array([None if s is None else metadata_row(s) for s in sources.to_pylist()], schema)

    text = F.coalesce("raw", F.lit(""))
    whole = F.coalesce(F.length(link_text.head(text)) > 0, F.lit(False))
    rows = notes.select("id", "path", "raw", F.when(F.col("reason") != "", F.col("reason")).alias("given"), whole.alias("whole"))
    text = F.when(F.col("given").isNull() & F.col("whole"), F.col("raw"))
    rows = rows.select("*", link_text.after_head(text).alias("body_text"), read(link_text.head_source(text)).alias("meta"))
    rows = rows.select("*", F.when(F.col("meta.reason").isNull(), link_text.links(F.col("body_text"), F.col("id"))).alias("found"))
    unclosed = F.when(F.coalesce("raw", F.lit("")).rlike(link_text.OPENING), "closing").otherwise("opening")
    missing = F.when(~F.col("whole"), F.concat(F.lit("missing "), unclosed, F.lit(" '---' frontmatter delimiter")))
    rows = rows.select("*", F.coalesce("given", missing, "meta.reason", link_text.escape_reason(F.col("found"))).alias("reason"))
    good = F.col("reason").isNull()
    made = {
        "body": F.col("body_text"),
        "outbound_links": F.array_distinct(F.transform("found", lambda x: x.target_id)),
        "links": link_text.numbered(F.col("found")),
    } | {name: F.col("meta")[name] for name in kind.names if name != "reason"}
    return rows.select([F.when(good, made[f.name]).alias(f.name) if f.name in made else F.col(f.name) for f in PARSED])


def concepts_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")


def skipped_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("path", "reason")


def occurrences(concepts: DataFrame) -> DataFrame:
    """One row for each link occurrence: source_id, edge_pos, target_id, anchor_text, link_kind."""
    return concepts.select(F.col("id").alias("source_id"), F.inline("links"))


def index_row(raw: str) -> tuple[str | None, str | None, list[str]]:
    """(title, description, concept_ids) of an index; ids in order, first of repeats."""
    return (*index_heading(raw), list(dict.fromkeys(e["target_id"] for e in links(raw, "index"))))


def parse_indexes(rows: DataFrame) -> DataFrame:
    """Rows with an index text ``raw`` get title, description, concept_ids and reason; a bad one has its reason only."""
    kind = StructType([StructField("title", _TEXT), StructField("description", _TEXT), StructField("concept_ids", _LIST), StructField("reason", _TEXT)])

    def parse(raw: str | None) -> tuple:
        try:
            return (*index_row(raw or ""), None)
        except Invalid as e:
            return None, None, None, str(e)

    return rows.withColumn("_index", F.udf(parse, kind, useArrow=True)("raw")).select("*", "_index.*").drop("_index")
