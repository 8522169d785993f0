"""Queries against DuckDB on tables that repeat rows, as larger ones do."""

import duckdb
import pytest
from pyspark.sql import functions as F

from prismlake.functions import metrics
from prismlake.plans import catalogue

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Some users' events sixty times."""
    to = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + i * 1000000 AS event_id) FROM '{SF}/events.parquet', range(60) t(i) WHERE user_id IN (460, 698, 977, 1042, 1066)) TO '{to}/events.parquet' (FORMAT parquet)")
    return str(to)


def differ(spark, name, sf_dir):
    """Scores that are further from the SQL's than its rounding."""
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    theirs = dict(duckdb.sql(catalogue.ORACLES[name]).fetchall())
    ours = {r["user_id"]: r["score"] for r in catalogue.QUERIES[name](spark, sf_dir).collect()}
    assert set(ours) == set(theirs)
    return {k: (v, theirs[k]) for k, v in ours.items() if abs(v - theirs[k]) > 1.5e-5}


def test_percentiles_between_equal_values(spark):
    """Weighted sums of two equal values may be off by a bit, and then none of them is in the band."""
    cases = [(v / 100, n) for v in (701, 18153, 22571, 23022, 20790) for n in range(2, 60)]
    rows = spark.createDataFrame(cases, "v double, n int").withColumn("a", F.expr("array_repeat(v, n)"))
    moved = [rows.where(metrics.percentile_of(F.col("a"), share) != F.col("v")).count() for share in (0.6, 0.95, 0.999)]
    assert moved == [0, 0, 0]


def test_band_fallback(spark, repeated):
    assert not differ(spark, "band_fallback", repeated)


def test_band_mean(spark, repeated):
    assert not differ(spark, "band_mean", repeated)


def test_sums_do_not_depend_on_the_order(spark):
    values = [[1e16, 1.0, -1e16], [float("inf"), 1.0], [0.1] * 10]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>").select("i", metrics.exact_sum(F.col("v")).alias("s"))
    assert [r["s"] for r in rows.orderBy("i").collect()] == [1.0, float("inf"), 1.0]


def test_band_sum(spark, repeated):
    assert not differ(spark, "band_sum", repeated)
