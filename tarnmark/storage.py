"""Where intermediate tables live: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnmark.errors import StorageError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session (tests, a laptop) leaves it unset, a local folder made once."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    own = spark.conf.get("tarnmark.shared.dir", None)
    if not own:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise StorageError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        own = "file://" + tempfile.mkdtemp(prefix="tarnmark-")
        spark.conf.set("tarnmark.shared.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tarnmark/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these tables; others, and None, are left alone.

    Only for tables that no later action reads.
    """
    for df in tables:
        path = getattr(df, "written_to", None) if df is not None else None
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
