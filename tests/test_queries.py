"""Every array query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import arrayspark.queries as q

D = "/root/testdata/sf0.001"
TABLES = "events embeddings part orders customer lineitem"


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_each_query_has_sql():
    assert set(q.QUERIES) == set(q.SQL)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, D)
    want = con.sql(q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(map(_value, r)) for r in df.collect()), key=key)
    exact = sorted((tuple(_value(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert len(got) == len(exact)
    for x, y in zip(got, exact, strict=True):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)) for a, b in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(q.QUERIES) <= set(e.queries()) and set(q.SQL) <= set(e.oracle_sql())


def _exact(spark, tmp_path, name, values):
    """Rows of a query and of its SQL over events of these values, floats to the last bit."""
    events = f"{tmp_path}/events.parquet"
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.mode("overwrite").parquet(events)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/*.parquet'")
    df = q.QUERIES[name](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({q.SQL[name]})").fetchall()
    return [sorted(map(repr, map(tuple, rows))) for rows in (df.collect(), want)]


@pytest.mark.parametrize("name", ["expr_divide", "expr_log", "expr_poly"])
def test_floats_are_rounded_as_in_sql(spark, tmp_path, name):
    # next to the poles, on them, and near ties of the last digit
    odd = [6.5499999519294105, 6.55, 6.55000000925233, 6.550000000000001, 50.0, 50.00000000000001, 49.99, 86.55986289924178, 134.04189120184745, 166.26840265714003]
    got, want = _exact(spark, tmp_path, name, odd + [7.83 + k for k in range(90)])
    assert got == want


@pytest.mark.parametrize("digits", [0, 2, 6])
def test_rounding(spark, digits):
    x = [0.0, 0.5, -0.5, 2.5, 0.49999999999999994, 1.005, -1.0000005, 2.0**52 + 0.5, 1.2345678e17, 7.4e21, 1e305, -1.7e308, math.inf, -math.inf, math.nan]
    c = duckdb.connect()
    want = [c.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchall()[0][0] for v in x]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").coalesce(1).select(q.rounded(q.F.col("v"), digits)).collect()]
    assert [repr(v + 0.0) for v in got] == [repr(v + 0.0) for v in want] == [repr(q.nearest(v, digits) + 0.0) for v in x]


def test_elements_stay_off_the_driver(spark, con, monkeypatch):
    def fetched(*_):
        raise AssertionError("cells are fetched by the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", fetched)
    df = q.QUERIES["iterate_elements"](spark, D)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(q.SQL["iterate_elements"]).fetchall())
