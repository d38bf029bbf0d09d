"""Every query with SQL, held against DuckDB on the smallest tables; the others must run."""

import math

import pytest

from threadloom import queries as core

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(core.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert not [d for d in cursor.description if "DECIMAL" in str(d[1])]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_query_runs(spark, sf, name):
    """Those without SQL have rows, of known types; what they hold is tested with their operators."""
    df = core.QUERIES[name](spark, sf)
    assert df.limit(5).collect() and "void" not in {kind for _, kind in df.dtypes}


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
