"""Every query with SQL gives the SQL's rows on a small scale; the others give rows."""

import duckdb
import pytest

import __spark_entry__
from marlstone.plans import coverage_queries, fact_queries, lookup_queries, plan_queries, report_queries, session_queries, text_queries, work_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES = {**coverage_queries.QUERIES, **text_queries.QUERIES, **lookup_queries.QUERIES, **work_queries.QUERIES, **report_queries.QUERIES, **fact_queries.QUERIES, **plan_queries.QUERIES, **session_queries.QUERIES}
SQL = {**coverage_queries.SQL, **text_queries.SQL, **lookup_queries.SQL, **work_queries.SQL, **report_queries.SQL, **fact_queries.SQL, **plan_queries.SQL, **session_queries.SQL}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
