"""What the operators of this subpackage share: the shared folder, written tables, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one, but only if all runs in one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(spark, "_threadloom_dir", None) or f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark._threadloom_dir = folder
    return folder.rstrip("/")


TEXTS = 2000  # whole texts in an Arrow batch
BATCH_BYTES = 4 << 20


CACHES: list[dict] = []  # of this process, emptied with every partition


def tidied(run):
    """A function of Arrow batches that hands freed memory back to the system when its partition is done: workers are
    kept for later stages, beside a JVM that has grown meanwhile."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


def hand_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    for cache in CACHES:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_batches(df: DataFrame, rows: int = TEXTS, size: int = BATCH_BYTES) -> DataFrame:
    """df, in whose session Arrow batches hold so many rows and bytes at most: texts may be long, and a batch is held
    whole, in the JVM and in Python. A row longer than that is a batch of its own."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")  # so that all operators share one pool of workers
    limits = {"maxRecordsPerBatch": rows, "maxBytesPerBatch": size}
    for name, most in limits.items():
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.match(r"-?\d+", conf.get(key))[0]) <= most:
            conf.set(key, str(most))
    return df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds as a table, without Python workers (which a list given to Spark would start, in a pool
    of their own beside that of the operators)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    import pyarrow as pa

    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), kind)


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tl_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tl_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def apart(key: Column) -> Column:
    """A key as good as this integer one, which the planner takes for another: a join on it gets exchanges of its own,
    whose large partitions adaptive execution splits, where those of an aggregate by the key itself would be reused."""
    return key.bitwiseXOR(F.lit(1))


def offsets(sums: DataFrame, key: str, value: str, group: list[str] | None = None, wide: int = 4096) -> DataFrame:
    """Exclusive prefix sums of value along the integer key (from 0, within group), as column `before`.

    Keys are summed in runs of `wide` first, so that no task reads more than `wide` rows of a group or one row a run.
    """
    group = group or []
    runs = sums.withColumn("_run", F.floor(F.col(key) / wide).cast("long"))
    starts = runs.groupBy(*group, "_run").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*group, "_run", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for c in [*group, "_run"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    starts = starts.hint("merge")  # a row a run, which grows with the input: never broadcast
    out = runs.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("a").join(starts.alias("b"), same)
    return out.select(*[F.col(f"a.{c}").alias(c) for c in sums.columns], (F.col("b._start") + F.col("a._in")).cast("long").alias("before"))
