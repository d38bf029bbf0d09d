"""Interval and as-of joins along positions of a text or a time line.

Containment uses one pass over positions where ranges nest or follow one another by start; each is partitioned by the
entity, so a page's ranges and points meet in one place and nothing else does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_containing(points: DataFrame, ranges: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """points (key, pos, ...) with columns of the first range (by start, then end) that holds them: start <= pos < end.

    ranges: (key, start, end, carry...), in any position to one another. Points outside all ranges have nulls. A range
    within an earlier one is never the first; the others start and end in one order, so the first of them that ends
    after a point holds it, or none does: two passes along positions, no pairs of points and ranges."""
    order = Window.partitionBy(key).orderBy("start", "end", F.struct(*carry))
    r = ranges.where("start < end").withColumn("_before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.where(F.col("_before").isNull() | (F.col("end") > F.col("_before")))
    columns = [c for c in points.columns if c != key]
    events = points.select(key, F.col("pos").alias("_at"), F.lit(0).alias("_kind"), F.struct(*columns).alias("_p")).unionByName(
        r.select(key, F.col("end").alias("_at"), F.lit(1).alias("_kind"), F.struct("start", F.struct(*carry).alias("c")).alias("_r")), allowMissingColumns=True
    )
    back = Window.partitionBy(key).orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = events.withColumn("_r", F.last("_r", ignorenulls=True).over(back)).where("_kind = 0")
    inside = F.when(F.col("_r.start") <= F.col("_at"), F.col("_r.c"))
    return held.select(key, "_p.*", inside.alias("_c")).select(*points.columns, *[F.col(f"_c.{c}").alias(c) for c in carry])


def link_types(links: DataFrame, environments: DataFrame, navigation: DataFrame) -> DataFrame:
    """links (page_id, target, pos) typed by the environment that holds them, as navigation before the first heading.

    environments: (page_id, start, end, type, idx); navigation: (page_id, end)."""
    from threadloom.fixed_values import LINK_BY_ENVIRONMENT

    table = F.create_map(*[F.lit(x) for kv in LINK_BY_ENVIRONMENT.items() for x in kv])
    typed = first_containing(links, environments.withColumnRenamed("type", "env_type"), "page_id", ["env_type", "idx"])
    typed = typed.join(navigation.select("page_id", F.col("end").alias("_nav")), "page_id", "left")
    nav = F.col("pos") < F.coalesce("_nav", F.lit(0))
    kind = F.when(nav, "link/navigation").otherwise(F.coalesce(F.element_at(table, F.col("env_type")), F.lit("link/prose-ref")))
    return typed.select("page_id", "target", "pos", kind.alias("link_type"), F.when(~nav, F.col("idx")).alias("env_idx"))


def between_neighbours(points: DataFrame, wires: DataFrame, key: str) -> DataFrame:
    """wires (key, wire_id, pos) with the nearest point (key, point_id, pos) strictly before and strictly after; wires
    that miss one, or have the same on both sides, go."""
    events = points.select(key, "pos", F.lit(None).cast("string").alias("wire_id"), F.col("point_id").cast("string").alias("point_id")).unionByName(
        wires.select(key, "pos", F.col("wire_id").cast("string").alias("wire_id"), F.lit(None).cast("string").alias("point_id"))
    )
    order = Window.partitionBy(key).orderBy("pos")
    before, after = order.rangeBetween(Window.unboundedPreceding, -1), order.rangeBetween(1, Window.unboundedFollowing)
    latest = F.max(F.when(F.col("point_id").isNotNull(), F.struct("pos", "point_id"))).over(before)
    nearest = F.min(F.when(F.col("point_id").isNotNull(), F.struct("pos", "point_id"))).over(after)
    out = events.withColumn("_b", latest).withColumn("_a", nearest).where("wire_id IS NOT NULL")
    out = out.select(key, "wire_id", F.col("_b.point_id").alias("source"), F.col("_a.point_id").alias("target"))
    return out.where("source IS NOT NULL AND target IS NOT NULL AND source <> target")


def enclosing(rows: DataFrame, headings: DataFrame, key: str, name: str) -> DataFrame:
    """rows (key, pos, ...) with the last heading (key, pos, name) at or before their position."""
    columns = rows.columns
    h = headings.select(key, "pos", F.col(name), F.lit(0).alias("_is_row"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns if c not in (key, "pos")])
    r = rows.select(*columns, F.lit(None).cast(headings.schema[name].dataType).alias(name), F.lit(1).alias("_is_row"))
    order = Window.partitionBy(key).orderBy("pos", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    return h.unionByName(r).withColumn(name, F.last(name, ignorenulls=True).over(order)).where("_is_row = 1").select(*columns, name)


def next_proof(blocks: DataFrame, key: str, gap: str | None = None, most: int = 50, ties: tuple[str, ...] = ()) -> DataFrame:
    """blocks (key, env, start, end, in the order of start and of the columns in ties) with proof_start, proof_end: the next block, if it is a proof and nearer than `most`.

    gap: a column with the comment-free length of what lies between a block's end and the next's start; else offsets."""
    order = Window.partitionBy(key).orderBy("start", *ties)
    after = lambda c: F.lead(c).over(order)
    near = F.col(gap) if gap else after("start") - F.col("end")
    hit = (after("env") == "proof") & (near < most)
    return blocks.withColumn("proof_start", F.when(hit, after("start"))).withColumn("proof_end", F.when(hit, after("end")))


def numbered(rows: DataFrame, group: list[str], order: list[str], to: str = "number") -> DataFrame:
    """Rows numbered from 1 in their group."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def sequence_ids(rows: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """hx_id: key:kind-NNN, numbered from 0; numbers beyond 999 keep all their digits."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("hx_id", F.concat(F.col(key), F.lit(f":{kind}-"), F.format_string("%03d", n)))
