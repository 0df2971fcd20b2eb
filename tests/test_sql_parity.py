"""Every registered query with SQL against an independent database, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return "~" if value is None else repr(value)


def test_names_are_unique_and_covered():
    plans = entry_module._plans()
    assert len(QUERIES) == sum(len(p.QUERIES) for p in plans)
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    order = sorted(frame.columns)
    rows = frame.select(*[f"`{c}`" for c in order]).collect()
    cursor = db.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert order == sorted(names)
    place = [names.index(c) for c in order]
    expected = sorted(tuple(plain(row[i]) for i in place) for row in cursor.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in rows) == expected


def test_queries_without_sql_are_those_with_tests_of_their_own():
    """Only the text operators have none; tests/llm compares each with brute force."""
    own = {name for plan in entry_module._plans() if plan.__name__.startswith(("driftlens.llm", "corpus_pipeline")) for name in plan.QUERIES}
    assert set(QUERIES) - set(SQL) <= own
