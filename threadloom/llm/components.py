"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import apart, discard, written

LOCAL_LINKS = 500_000  # in a batch that is contracted at once


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links a-b that isn't the least of its component, with that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], m)
        np.minimum.at(new, low[y], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    other = low != np.arange(len(nodes))
    return nodes[other], nodes[low[other]]


def _contracted(batches):
    held: list[pa.RecordBatch] = []

    def flush():
        a, b = contract(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LOCAL_LINKS:
            yield flush()
    if held:
        yield flush()


def _with_least(links: DataFrame) -> DataFrame:
    """links with m, the least b of each a: summed up before the shuffle and joined, so that a hub's links may be split."""
    least = links.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))
    return links.join(least, apart(F.col("a")) == apart(F.col("_a"))).select("a", "b", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of links(a long, b long) that isn't the least itself.

    Partitions contract their links first; then rounds join each node's neighbours to the least of them (the greater
    ones, then the others) until nothing changes. Each round is written to the shared folder, and the round before is deleted.
    """
    schema = "a long, b long"
    held = links = written(links.where("a <> b").mapInArrow(_contracted, schema), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        small = _with_least(large)  # here a > b
        links = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        last, links = held, written(links, "links")
        held = links
        discard(last)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now
