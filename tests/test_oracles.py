"""Every registered query against its SQL oracle, and the rows-only ones for running at all."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()
# Long-running models have tests of their own.
SLOW = {"churn_model", "churn_scores", "ltv_model", "ltv_importance", "attributions", "explain_top"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns, rows = _rows(df.columns, df.collect())
    result = duck.execute(ORACLES[name])
    expected_columns, expected = _rows([d[0] for d in result.description], result.fetchall())
    assert columns == expected_columns
    assert len(rows) == len(expected)
    for got, want in zip(rows, expected):
        assert all(_close(x, y) for x, y in zip(got, want)), (got, want)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and n not in SLOW))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
