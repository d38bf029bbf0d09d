"""Directories as streams: reports of new files, and harvests that resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of JSON files as they appear in a folder."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def watched(spark: SparkSession, folder: str, schema: str, report: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """report() of each micro-batch as Parquet under its batch number, so that a batch run again replaces itself.

    Files are read once; what was read is in the checkpoint, and survives a restart. Without `every` the query takes
    what is there and stops."""
    def write(batch: DataFrame, number: int) -> None:
        report(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = json_stream(spark, folder, schema).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def harvested(spark: SparkSession, folder: str, schema: str, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Records of a key once, appended; the keys seen are the query's state and survive a restart."""
    s = json_stream(spark, folder, schema).dropDuplicates([key])
    return s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
