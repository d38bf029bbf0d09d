"""Writers: JSON, EDN, vectors, manifests, reports, diagrams. Tables stay Parquet unless another form is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """JSON lines, one file a partition; one file only where its reader asks for that."""
    (df.coalesce(1) if single else df).write.mode(mode).json(path)


def both(df: DataFrame, table: str, lines: str) -> None:
    """The Parquet table, and JSON lines written from it."""
    df.write.mode("overwrite").parquet(table)
    df.sparkSession.read.parquet(table).write.mode("overwrite").json(lines)


def edn_value(c: Column) -> Column:
    """A scalar or string column as EDN."""
    return F.when(c.isNull(), F.lit("nil")).otherwise(c.cast("string"))


def edn_string(c: Column) -> Column:
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(c.isNull(), F.lit("nil")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def edn_maps(df: DataFrame, namespace: str = "") -> DataFrame:
    """edn: each row as a map with keyword keys; strings are quoted, numbers and booleans not, arrays are vectors."""
    prefix = f":{namespace}/" if namespace else ":"
    parts = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        value = edn_string(c) if kind == "string" else F.concat(F.lit("["), F.array_join(F.transform(c, edn_string if kind == "array<string>" else edn_value), " "), F.lit("]")) if kind.startswith("array") else edn_value(c)
        parts.append(F.concat(F.lit(f"{prefix}{f.name} "), value))
    return df.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("edn"))


def vectors(df: DataFrame, path: str) -> None:
    """(id, embedding) as Parquet: order of rows carries nothing."""
    df.write.mode("overwrite").parquet(path)


def manifest(df: DataFrame, stage: str) -> DataFrame:
    """stage, metric, value of a one-row table of numbers, ready to be appended to a run's manifest."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
    return df.select(F.lit(stage).alias("stage"), F.explode(pairs).alias("p")).select("stage", "p.*")


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown(gates: DataFrame, title: str) -> str:
    """A report of gates (gate, status): a few rows, so it is put together on the driver."""
    rows = [f"| {r['gate']} | {r['status']} |" for r in gates.orderBy("gate").collect()]
    return "\n".join([f"# {title}", "", "| gate | status |", "|---|---|", *rows, ""])


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """thread_id, mermaid: a flow chart of each thread's wiring."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    n = nodes.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("  "), safe("node_id"), F.lit('["'), "node_type", F.lit('"]')))).alias("n"))
    e = edges.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("  "), safe("source"), F.lit(" -->|"), "edge_type", F.lit("| "), safe("target")))).alias("e"))
    j = n.join(e, "thread_id", "left")
    return j.select("thread_id", F.concat_ws("\n", F.lit("flowchart TD"), F.array_join("n", "\n"), F.nullif(F.array_join(F.coalesce("e", F.array().cast("array<string>")), "\n"), F.lit(""))).alias("mermaid"))


def graphviz(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """thread_id, dot."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    n = nodes.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("  "), quoted("node_id"), F.lit(" [label="), quoted("node_type"), F.lit("];")))).alias("n"))
    e = edges.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("  "), quoted("source"), F.lit(" -> "), quoted("target"), F.lit(" [label="), quoted("edge_type"), F.lit("];")))).alias("e"))
    none = F.array().cast("array<string>")
    return n.join(e, "thread_id", "left").select("thread_id", F.concat_ws("\n", F.lit("digraph {"), F.array_join("n", "\n"), F.array_join(F.coalesce("e", none), "\n"), F.lit("}")).alias("dot"))


def prompt_lines(prompts: DataFrame, path: str) -> None:
    """entity_id, question_id, stage, prompt as JSON lines."""
    prompts.select("entity_id", "question_id", "stage", "prompt").write.mode("overwrite").json(path)


def graph_cache(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Feature and edge tables of graphs, kept under a path and read from there if they are there already."""
    from threadloom.plans.stages import run_stages

    kept = run_stages(nodes.sparkSession, path, [("nodes", lambda _: nodes), ("edges", lambda _: edges)])
    return kept["nodes"], kept["edges"]
