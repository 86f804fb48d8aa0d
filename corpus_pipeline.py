"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes every stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm import decontaminate, near_dup, packing, pii, quality
from tarnmark.llm.common import materialize, table
from tarnmark.llm.tokens import public_path
from tarnmark.shipping import ship
from tarnmark.storage import discard


def _spare(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with a further column that tells rows apart, in the order of their ids, missing ids last; its name, and another spare name."""
    number, other = _spare(docs, "row_number"), _spare(docs, "row_gone")
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(number, F.col("doc_id")), number, other
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return materialize(ordered.withColumn(number, F.monotonically_increasing_id()), "rows"), number, other


def _without(rows: DataFrame, gone: DataFrame, number: str, other: str) -> DataFrame:
    """Rows whose number is not a doc_id of gone."""
    gone = gone.select(F.col("doc_id").alias(other))
    return rows.join(gone, F.col(number) == F.col(other), "left_anti").drop(number)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty; repeated rows are scored each; all columns stay as they are.
    """
    return quality.good_documents(docs, table(ship(spark), sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) one row stays, of the smallest id; rows without an id come last.

    Null, empty and blank texts are copies of nothing and stay; of repeated rows one stays; all columns stay as they are.
    """
    rows, number, other = _numbered(docs)
    found = near_dup.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), width=5, threshold=80)
    return _without(rows, found.where("not kept"), number, other)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go.

    Null and empty texts stay; rows that share an id, or have none, are judged by their own texts; all columns stay as they are.
    """
    rows, number, other = _numbered(docs)
    found = decontaminate.contamination(rows.select(F.col(number).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.where("contaminated"), number, other)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars, where there is one, follows the text.

    Null texts stay null; repeated rows are masked each; other columns stay as they are.
    """
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 1024 with little padding: one row per piece.

    Null and empty texts have the end id only; repeated rows are packed each; other columns are ignored.
    """
    return packing.pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]

#: Tokenizers and trained models are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
