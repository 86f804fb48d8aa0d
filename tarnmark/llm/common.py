"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.storage import fresh_path, materialize, shared_dir

__all__ = ["fresh_path", "is_held_out", "materialize", "per_batch", "shared_dir", "table", "tidy", "text_or_empty", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept back from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives free memory back to the system when its task ends.

    Workers live on for later tasks, and idle ones count against an executor's memory too.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim is not None:
                trim(0)

    return wrapped


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> Callable:
    """A mapInArrow function from a factory; the factory runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out

    return tidy(run)
