"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, but only if all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(spark, "_threadloom_tables", None) or f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark._threadloom_tables = folder
    return folder.rstrip("/")


SPLIT_BYTES, MOST_DEALT = 16 << 20, 64


def dealt(df: DataFrame) -> DataFrame:
    """A small table dealt out to all cores. A file of one row group is one task, however slow the functions on its rows
    are; tables beyond a split for each core, 64 at most, have splits enough and stay as they are."""
    n = min(df.sparkSession.sparkContext.defaultParallelism, MOST_DEALT)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if 1 < n and size < n * SPLIT_BYTES else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, read again: where lineage or a plan would grow, it ends here."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
