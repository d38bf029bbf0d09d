"""The batch pipeline as named stages over tables: each is skipped where its table exists, and can be run alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there (its success mark), in any file system Spark reads."""
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], again: bool = False) -> dict[str, DataFrame]:
    """The stages' tables by name. Each stage sees the tables before it, writes its own under its name, and is passed
    over if that is there already."""
    tables: dict[str, DataFrame] = {}
    for name, stage in stages:
        path = f"{folder}/{name}"
        if again or not table_exists(spark, path):
            stage(tables).write.mode("overwrite").parquet(path)
        tables[name] = spark.read.parquet(path)
    return tables


def shard_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All shards' tables as one read; columns that a shard lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def merged_stats(stats: DataFrame) -> DataFrame:
    """Numbers of shards (stage, metric, value) added up; averages and distinct counts add up to nothing meant, and are
    better computed from the union of rows."""
    return stats.groupBy("stage", "metric").sum("value").withColumnRenamed("sum(value)", "value")
