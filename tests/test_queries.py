"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from prismlake.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    return float(value) if isinstance(value, (int, float)) else value


def rows(names, records):
    order = sorted(names)
    where = [list(names).index(n) for n in order]
    return order, sorted(repr(tuple(plain(r[i]) for i in where)) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLES[name])
    theirs = rows([d[0] for d in result.description], result.fetchall())
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_stable_samples(spark):
    first = catalogue.QUERIES["random_select_hash"](spark, SF)
    assert sorted(first.collect()) == sorted(catalogue.QUERIES["random_select_hash"](spark, SF).collect())
