"""Deterministic samples, stratified and capped selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_sample(df: DataFrame, groups: list[str], key: str, n: int, seed: str) -> DataFrame:
    """The n rows of each group of least sha256(seed|groups|key), then key: the sample is the operator."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(g).cast("string") for g in groups], F.col(key).cast("string")).cast("binary"), 256)
    order = Window.partitionBy(*groups).orderBy(digest, key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def strata(score) -> Column:
    """easy from a score of 20, medium from 5, else hard."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 20, "easy").when(s >= 5, "medium").otherwise("hard")


def stratified_top(df: DataFrame, stratum: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each stratum."""
    w = Window.partitionBy(stratum).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def capped_selection(df: DataFrame, kind: str, score: str, key: str, n: int) -> DataFrame:
    """The n best by score of which no kind has more than n // 3 + 1: greedy choice as two rankings."""
    cap = n // 3 + 1
    within = df.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(score), key))).where(F.col("_k") <= cap)
    return within.orderBy(F.desc(score), key).limit(n).drop("_k")


def showcases(df: DataFrame, key: str, criteria: list[str]) -> DataFrame:
    """One row for each criterion in turn, the highest not picked before: a report of a few rows."""
    picked, out = [], None
    for c in criteria:
        best = df.where(~F.col(key).isin(picked) if picked else F.lit(True)).orderBy(F.desc(c), key).limit(1).withColumn("criterion", F.lit(c))
        row = best.first()
        if row is None:
            break
        picked.append(row[key])
        out = best if out is None else out.unionByName(best)
    return out if out is not None else df.limit(0).withColumn("criterion", F.lit(""))


def eligible_questions(posts: DataFrame, topics: DataFrame, least: int) -> DataFrame:
    """(topic, id) of answered questions of a score with a topic's tag; a question may serve several topics.

    posts: (id, kind, score, answer_count, tags); topics: (topic, tag)."""
    q = posts.where((F.col("kind") == "question") & (F.col("score") >= least) & (F.col("answer_count") > 0))
    return q.select("id", F.explode("tags").alias("tag")).join(topics, "tag").select("topic", "id").distinct()
