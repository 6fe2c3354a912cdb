"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from brightmill.plans import registry

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in records)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert not [t for t in map(str, expected.types) if "DECIMAL" in t or "HUGEINT" in t]
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {"s6_search_results", "x15_page_links"}
