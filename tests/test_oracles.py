"""Every registered query next to its DuckDB statement on the smallest data."""
import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracles import table
from syllabase.checks.roles import BASE

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = entry_points.queries()[name](spark, SMALL)
    got = table(df.columns, df.collect())
    cur = duck.execute(entry_points.oracle_sql()[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_entry_gives_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["institution_id", "name", "reviews_count", "avg_rating", "likes_count"] and df.count() > 0
