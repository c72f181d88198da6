"""The registered queries against DuckDB."""

import math

import duckdb
import pytest

from logquern import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "part")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(([clean(r[i]) for i in order] for r in values), key=str)


@pytest.mark.parametrize("name", [q for q in catalog.QUERIES if q in catalog.ORACLES])
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_plans(spark):
    """Queries of the language and of native parsers run without Python."""
    for name in ("dsl_filter_group", "parse_filterlog", "volume_flags"):
        assert "Python" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
