"""Exact top-k search by inner product over integer vectors: columnar branch and bound.

Candidates are cut by hash into blocks that a task can hold, each kept dimension by dimension (vertical layout).
A query's scores grow dimension block by dimension block, dimensions of much query mass first. After each block the
mass that query and candidate have left bounds what a score can still become (Cauchy-Schwarz); candidates whose
upper bound is below the k-th best lower bound go, and the survivors are compacted. Ties survive, so results are exact.

Queries meet candidate blocks by block number: each pair (candidate block, query block) is one row on either side. Every
pair of a query and a candidate must be bounded somewhere, so n candidates and m queries in blocks of b move 2 n m / b
vectors, two bytes a component where these are small; b is as large as a task can hold (65,536 vectors of 64 components:
8 MB small, 32 MB else).

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without id; vectors of other
lengths than the query's aren't its candidates. Equal rows count once; where an id repeats with other vectors, its best
score counts and none of its rows is its own candidate. Sums beyond the range of long saturate. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 4096, 65536, 65536
DIMENSIONS = 8  # in a block of dimensions
BATCH = 64  # queries whose first block of dimensions is accumulated at once


def _pack(table: pa.Table) -> pa.Table:
    """Rows of a block as one row: ids and the matrix, dimension by dimension, in doubles (whole numbers)."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = table.column("dim")[0].as_py()
    matrix = flat.reshape(len(ids), wide)[order] if wide else np.zeros((len(ids), 0))
    small = not matrix.size or np.abs(matrix).max() < 2**15
    return pa.table({
        "block": table.column("block")[:1], "dim": table.column("dim")[:1], "small": pa.array([bool(small)]),
        "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
        "matrix": pa.array([np.ascontiguousarray(matrix.T).astype("<i2" if small else "<f8").tobytes()], pa.binary()),
    })


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    row = table.to_pylist()[0]
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["matrix"], "<i2" if row["small"] else "<f8").reshape(row["dim"], len(ids))


def _best(ids: np.ndarray, scores, k: int) -> list[tuple[int, int]]:
    """The k highest (score, smaller id first), each id once."""
    out, seen = [], set()
    for s, i in sorted(zip((-int(x) for x in scores), ids.tolist(), strict=True)):
        if i not in seen:
            seen.add(i)
            out.append((i, -s))
            if len(out) == k:
                break
    return out


def _saturated(x: int) -> int:
    return max(-(2**63), min(2**63 - 1, x))


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int):
    """Yields (position of the query, [(id, score)]) over one block; queries and columns are dimension by dimension."""
    wide = len(columns)
    left = np.sqrt(np.square(columns.astype(np.float64)).sum(0).max(initial=0) * np.square(queries.astype(np.float64)).sum(0).max(initial=0))
    if left >= 2**52:  # beyond exact doubles
        for q in range(len(query_ids)):
            mine = [int(x) for x in queries[:, q]]
            keep = np.flatnonzero(ids != query_ids[q])
            yield q, [(i, s) for i, s in _best(ids[keep], [_saturated(sum(a * int(b) for a, b in zip(mine, columns[:, c], strict=True))) for c in keep], k)]
        return
    kind = np.float32 if left < 2**23 else np.float64
    # dimensions in which the queries have most mass come first, for the whole block alike
    order = np.argsort(-np.square(queries.astype(np.float64)).sum(1), kind="stable")
    columns, queries = columns[order].astype(kind), queries[order].astype(kind)
    cuts = list(range(0, wide, DIMENSIONS)) or [0]
    # remaining mass of candidates and queries behind each block of dimensions
    rest_c = np.zeros((len(cuts) + 1, columns.shape[1]), np.float64)
    rest_q = np.zeros((len(cuts) + 1, queries.shape[1]), np.float64)
    for b in range(len(cuts) - 1, -1, -1):
        part = slice(cuts[b], cuts[b] + DIMENSIONS)
        rest_c[b] = rest_c[b + 1] + np.square(columns[part].astype(np.float64)).sum(0)
        rest_q[b] = rest_q[b + 1] + np.square(queries[part].astype(np.float64)).sum(0)
    rest_c, rest_q = np.sqrt(rest_c), np.sqrt(rest_q)
    repeats = len(np.unique(ids)) < len(ids)
    for lo in range(0, queries.shape[1], BATCH):
        first = queries[: DIMENSIONS, lo : lo + BATCH].T @ columns[: DIMENSIONS]
        for j in range(first.shape[0]):
            q = lo + j
            keep = np.flatnonzero(ids != query_ids[q])
            partial = first[j][keep].astype(np.float64)
            for b in range(1, len(cuts) + 1):
                if len(keep) > k and not repeats:  # with repeated ids the k-th best may be a copy's
                    slack = rest_q[b][q] * rest_c[b][keep]
                    floor = np.partition(partial - slack, len(keep) - k)[len(keep) - k]
                    stay = partial + slack >= floor - 1e-6 * (1 + abs(floor))
                    if not stay.all():
                        keep, partial = keep[stay], partial[stay]
                if b < len(cuts):
                    part = slice(cuts[b], cuts[b] + DIMENSIONS)
                    partial += queries[part, q] @ (columns[part][:, keep] if len(keep) < columns.shape[1] else columns[part])
            scores = np.rint(partial)
            if not repeats and len(keep) > k:
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                above, level = np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)
                some = np.concatenate([above, level[: k - len(above)]])  # ids ascend
                yield q, _best(ids[keep[some]], scores[some], k)
            else:
                yield q, _best(ids[keep], scores, k)


def _searcher(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            (ids, columns), (query_ids, queries) = _unpack(left), _unpack(right)
            for q, best in search_block(query_ids, queries, ids, columns, k):
                for i, s in best:
                    for name, x in zip(found, (int(query_ids[q]), i, s), strict=True):
                        found[name].append(x)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in found.items()})

    return search


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of highest inner product, ties to smaller vec_id.

    vectors and queries: (vec_id long, vec array<double> of whole numbers). A query's own id isn't its candidate.
    """
    def clean(df: DataFrame) -> DataFrame:
        x = df.select(F.col("vec_id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("v"))
        x = x.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        return x.withColumn("dim", F.size("v")).distinct()

    base, asked = clean(vectors), clean(queries)
    n, m = base.count(), asked.count()
    size = block or max(LEAST_BLOCK, min(MOST_BLOCK, n // 64))
    blocks, query_blocks = max(1, -(-n // size)), max(1, -(-m // QUERY_BLOCK))
    kind = "block long, dim int, small boolean, ids binary, matrix binary"

    def packed(df: DataFrame, count: int) -> DataFrame:
        df = df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(count)))
        return df.groupBy("block", "dim").applyInArrow(_pack, kind)

    left = packed(base, blocks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    right = packed(asked, query_blocks).withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["block", "other", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searcher(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
