"""Every registered query against its SQL in another engine."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES = entry_point.queries()
ORACLE = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    """Text operators without an SQL form are tested against brute force instead."""
    assert set(ORACLE) <= set(QUERIES)
    assert all(n == "pipeline" or n.startswith("op") for n in set(QUERIES) - set(ORACLE))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf_dir, engine):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    relation = engine.execute(ORACLE[name])
    found = [d[0] for d in relation.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    theirs = sorted(repr(tuple(r[i] for i in places)) for r in relation.fetchall())
    assert ours == theirs


def test_entry_returns_rows(spark):
    df = entry_point.entry(spark)
    assert "tavg_7d_avg" in df.columns
    assert not df.limit(1).isEmpty()
