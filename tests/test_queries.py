"""Every query of the library against its DuckDB text."""

import math

import duckdb
import pytest

from tidemill.plans.queries import ORACLE, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v if isinstance(v, (int, str, bool, type(None))) else float(v) if hasattr(v, "as_tuple") else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert got
        return
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_dates_beyond_the_year_9999(spark, duck, tmp_path):
    """Spark puts a plus before years of five digits, DuckDB doesn't."""
    d = str(tmp_path)
    duckdb.sql(f"COPY (SELECT * REPLACE (o_orderkey * 6000 AS o_orderkey) FROM '{SF}/orders.parquet') TO '{d}/orders.parquet'")
    df = QUERIES["fn_date_rest"](spark, d)
    want = duckdb.sql(ORACLE["fn_date_rest"].replace("FROM orders", f"FROM '{d}/orders.parquet'"))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall()) and max(len(r[sorted(df.columns).index("fu")]) for r in got) == 11
