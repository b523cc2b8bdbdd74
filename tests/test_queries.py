"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cadenza.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = sorted(map(repr, ([value(r[c]) for c in names] for r in df.collect())))
    expected = con.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert found == sorted(repr([value(r[i]) for i in order]) for r in expected.fetchall())


def test_every_query_is_named_once():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) - set(SQL) == {"format_results_text"}
