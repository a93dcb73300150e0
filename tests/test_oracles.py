"""Every registered query against its SQL twin, value by value."""

import math
import re

import duckdb
import pytest

from checks import all_oracles, all_queries

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _text(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sf_dir, duck, name):
    df = all_queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(_text(row[c]) for c in columns) for row in df.collect())
    sql = all_oracles().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(_text(row[i]) for i in at) for row in cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


def test_oracles_are_single_statements():
    assert all(";" not in re.sub(r"'(?:[^']|'')*'", "", sql) for sql in all_oracles().values())
