"""Every query with an oracle against DuckDB on the smallest test tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def canonical(frame):
    cols = sorted(frame.columns)

    def text(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, (bool, str)):
            return str(v)
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(v.tolist())
        try:
            return repr(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    return cols, sorted(tuple(text(v) for v in row) for row in frame[cols].itertuples(index=False))


def names():
    import __spark_entry__ as e

    return sorted(e.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0


@pytest.mark.parametrize("name", names())
def test_against_sql(spark, duck, name):
    import __spark_entry__ as e

    got = e.queries()[name](spark, DATA).toPandas()
    assert canonical(got) == canonical(duck.execute(e.oracle_sql()[name]).df())
