"""Pairs of vectors by blocks: no plan makes a row for each pair before its product is known."""

import pytest
from pyspark.sql import functions as F

from prismlake.operators import heatmap
from prismlake.plans import catalogue
from prismlake.plans.vector_queries import unit_patches

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("exclude", [None, "vec_id"])
@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_blocks_equal_the_join(spark, monkeypatch, exclude, broadcast):
    patches = unit_patches(spark, SF).where("p < 2 AND vec_id < 150")
    bank = patches.where("vec_id % 3 = 0").unionAll(patches.where("vec_id = 3"))
    joined = heatmap._joined_cosine(patches, bank, ["vec_id", "label"], exclude, 4, 0).groupBy("vec_id", "label", "p").agg(F.min("d").alias("d"))
    for name, value in (("BROADCAST_BYTES", broadcast), ("BLOCK", 32), ("BANK_BLOCK", 16), ("HELD", 64)):
        monkeypatch.setattr(heatmap, name, value)
    found = heatmap.min_cosine(patches, bank, ["vec_id", "label"], exclude=exclude)
    assert sorted(found.collect()) == sorted(joined.collect())  # to the last bit


def test_only_own_patches_in_the_bank(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (1, 1, [1.0, 0.0]), (None, 0, [1.0, 0.0])], "id long, p int, v array<double>")
    found = heatmap.min_cosine(rows, rows.where("id = 1"), ["id"], exclude="id")
    assert [tuple(r) for r in found.collect()] == [(2, 0, 1.0)]


def test_vectors_with_nulls_are_joined(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [None, 1.0]), (3, 0, None), (4, 0, [float("nan"), 0.0])], "id long, p int, v array<double>")
    found = {r["id"]: r["d"] for r in heatmap.min_cosine(rows, rows.where("id = 1"), ["id"]).collect()}
    assert found[1] == 0.0 and found[2] is None and found[3] is None and found[4] != found[4]


def test_heatmap_by_blocks(spark):
    assert "FlatMapGroupsInArrow" in plan(catalogue.QUERIES["heatmap_min_cosine"](spark, SF))


def test_flagship_computes_scores_once(spark):
    assert "InMemoryRelation" in plan(catalogue.QUERIES["flagship_auroc"](spark, SF))


def test_all_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(heatmap, "PAIR_BLOCK", 16)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 300")
    assert "FlatMapGroupsInArrow" in plan(catalogue.QUERIES["cosine_matrix"](spark, SF))
    found = {(r["label"], r["a"], r["b"]): r["cosine"] for r in heatmap.cosine_pairs(rows, "label", "vec_id", "embedding").collect()}
    odd = rows.unionAll(spark.createDataFrame([(1000, None, 3)], rows.schema))  # with a null the pairs are joined one by one
    joined = {(r["label"], r["a"], r["b"]): r["cosine"] for r in heatmap.cosine_pairs(odd, "label", "vec_id", "embedding").where("b < 1000").collect()}
    assert found.keys() == joined.keys() and all(abs(found[k] - joined[k]) < 1e-9 for k in found)
