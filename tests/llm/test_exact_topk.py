import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm.exact_topk import exact_topk, search_block


def plain(vectors, queries, k):
    out = {}
    for q, a in queries:
        best = {}
        for c, b in vectors:
            if c != q and len(a) == len(b):
                s = int(sum(int(x) * int(y) for x, y in zip(a, b)))
                best[c] = max(best.get(c, s), s)
        for c, s in best.items():
            out.setdefault(q, {})[c] = max(out.get(q, {}).get(c, s), s)
    return {(q, r + 1, c, s) for q, f in out.items() for r, (s, c) in enumerate(sorted(((s, c) for c, s in f.items()), key=lambda x: (-x[0], x[1]))[:k])}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 6), st.integers(0, 2**32 - 1), st.sampled_from([2, 300, 10**5, 10**9]))
def test_blocks_are_exact(n, wide, k, seed, span):
    rng = np.random.default_rng(seed)
    v = rng.integers(-span, span + 1, (n, wide)).astype(float)
    ids = np.sort(rng.choice(100, n, replace=False)).astype(np.int64)
    got = {(int(ids[q]), r + 1, c, s) for q, best in search_block(ids, v.T, ids, v.T, k) for r, (c, s) in enumerate(best)}
    rows = list(zip(ids.tolist(), v.tolist(), strict=True))
    assert got == plain(rows, rows, k)


def run(spark, rows, k=3, **kw):
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    return {tuple(r) for r in exact_topk(df, df.where("vec_id % 2 = 0"), k, **kw).collect()}


def test_ties_repeats_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(6)] + [(2, [1.0, 2.0]), (8, [0.0, 0.0]), (9, None), (10, [1.0, None]), (12, [math.nan, 1.0]), (14, [math.inf, 1.0]), (None, [9.0, 9.0]), (20, [3.0]), (21, [4.0]), (30, []), (31, []), (4, [-5.0, 1.0])]
    good = [(i, v) for i, v in {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))}]
    want = plain(good, [r for r in good if r[0] % 2 == 0], 3)
    assert run(spark, rows) == want == run(spark, rows, block=2)


def test_empty(spark):
    assert run(spark, []) == set() and run(spark, [(1, [1.0])]) == set()


@pytest.mark.parametrize("block", [None, 7])
def test_large_numbers_saturate(spark, block):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 5.0]), (2, [-(2.0**40), 5.0])]
    assert run(spark, rows, block=block) == {(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63)), (2, 1, 0, -(2**63)), (2, 2, 1, -(2**63))}


def test_query_equals_its_sql(spark, sf):
    import duckdb

    from threadloom.llm import queries

    want = duckdb.sql(queries.ORACLE["op1_exact_topk"].replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'")).fetchall()
    assert sorted(map(tuple, queries.op1_exact_topk(spark, sf).collect())) == sorted(want)
