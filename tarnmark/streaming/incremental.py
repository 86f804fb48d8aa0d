"""Incremental synchronisation: new or changed notes merge into a vector table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmark.operators.delta_store import DeltaStore
from tarnmark.operators.parsing import concepts_of, parse_notes
from tarnmark.operators.sync import prepared


def latest_of(notes: DataFrame) -> DataFrame:
    """One row (id, path, raw) of each id: the last modified one where rows tell when (``modified``), else the greatest text."""
    when = F.col("modified") if "modified" in notes.columns else F.lit(0)
    return notes.groupBy("id").agg(F.max(F.struct(when.alias("modified"), "raw", "path")).alias("n")).select("id", "n.path", "n.raw")


def sync_stream(notes: DataFrame, store: DeltaStore, bundle_root: str, checkpoint: str):
    """Start a stream of rows (id, path, raw[, modified]) into the store.

    Each batch appends what it adds or changes; the store knows the number of the
    last batch, so one that is repeated after a failure is not applied twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.sync(prepared(concepts_of(parse_notes(latest_of(batch))), bundle_root), batch=number)

    return notes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
