"""Column functions and kernels against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismlake import config as cfg
from prismlake.functions import geometry, ids, metrics, raster
from prismlake.operators import grids, select


def brute_auroc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("scores,labels,expected", [([1.0, 1, 1, 1], [1, 0, 1, 0], 0.5), ([3.0, 4, 1, 2], [1, 1, 0, 0], 1.0), ([1.0, 2, 3, 4], [1, 1, 0, 0], 0.0)])
def test_auroc_corner_cases(spark, scores, labels, expected):
    df = spark.createDataFrame(list(zip(map(float, scores), labels)), "s double, y int")
    assert metrics.thresholds(df, "s", F.col("y") == 1).agg(metrics.auroc()).first()[0] == expected


def test_auroc_random(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 40, 500).astype(float), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    assert metrics.thresholds(df, "s", F.col("y") == 1).agg(metrics.auroc()).first()[0] == pytest.approx(brute_auroc(s, y))
    up = df.withColumn("s", F.exp(F.col("s") / 10))
    assert metrics.thresholds(up, "s", F.col("y") == 1).agg(metrics.auroc()).first()[0] == pytest.approx(brute_auroc(s, y))


def test_one_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert metrics.thresholds(df, "s", F.col("y") == 1).agg(metrics.auroc(), metrics.average_precision()).first()[:] == (None, None)


@pytest.mark.parametrize("method", ["mean", "max", "sum", "median"])
def test_band_equals_kernel(spark, method):
    rng = np.random.default_rng(1)
    rasters = {1: rng.normal(size=100), 2: np.full(7, 3.0), 3: np.array([1.0, np.nan, 2]), 4: rng.normal(size=3)}
    df = spark.createDataFrame([(k, float(x)) for k, v in rasters.items() for x in v], "k int, v double")
    got = {r["k"]: r["score"] for r in metrics.band_score(df, ["k"], "v", 99, 99.5, method).collect()}
    for k, v in rasters.items():
        assert got[k] == pytest.approx(raster.band(v, 99, 99.5, method), nan_ok=True)


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "s double")
    assert df.where(metrics.is_finite("s")).count() == 1


@pytest.mark.parametrize("name,stem", [("001_00", "001"), ("001_100", "001_100"), ("a_b_07", "a_b"), ("nosuffix", "nosuffix")])
def test_stem(spark, name, stem):
    assert spark.createDataFrame([(name,)], "i string").select(ids.stem_of("i")).first()[0] == stem


@pytest.mark.parametrize("row,expected", [(("train", "normal", None), ("train", "good")), (("test", "normal", "x"), ("test", "good")), (("train", "anomaly", None), ("test", "anomaly")), (("test", "anomaly", "cut"), ("test", "cut"))])
def test_routing(spark, row, expected):
    df = spark.createDataFrame([row], "s string, l string, d string")
    assert tuple(df.select(*ids.routed("s", "l", "d")).first()) == expected


def test_defect_name(spark):
    assert spark.createDataFrame([("bubble,broken part",)], "d string").select(metrics.defect_column("d")).first()[0] == "auroc_bubble_broken_part"


def test_k_center_prefix_ties_and_clipping(spark):
    rng = np.random.default_rng(2)
    rows = [("p", i, [float(x) for x in rng.normal(size=4)]) for i in range(12)] + [("q", 1, [0.0, 0.0]), ("q", 2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "p string, i int, v array<double>")
    picks = lambda k: {p: [r["i"] for r in sorted(select.k_center(df, "p", "i", "v", k).where(F.col("p") == p).collect(), key=lambda r: r["rank"])] for p in "pq"}
    few, all_ = picks(4), picks(99)
    assert all_["p"][:4] == few["p"] and sorted(all_["p"]) == list(range(12)) and few["p"][0] == 0
    assert all_["q"] == [1, 2] and picks(0)["q"] == [1]


def test_random_needs_enough(spark):
    with pytest.raises(ValueError):
        select.random_k(spark.range(3), "id", 4)


def test_sampling_none_means_all(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    assert select.sample_per_group(df, ["g"], ["id"], 0).count() == 10
    assert select.sample_per_group(df, ["g"], ["id"], 3).count() == 6


@given(st.lists(st.floats(-5, 5), min_size=6, max_size=6))
@settings(max_examples=50, deadline=None)
def test_warp_identity_and_inverse(m):
    m = np.array(m).reshape(2, 3)
    m[0, 0] += 10
    m[1, 1] += 10
    inverse = np.linalg.inv(np.vstack([m, [0, 0, 1]]))
    assert np.allclose(np.vstack([m, [0, 0, 1]]) @ inverse, np.eye(3), atol=1e-6)
    a = np.arange(30.0).reshape(5, 6)
    assert np.allclose(raster.warp(a, np.array([[1, 0, 0], [0, 1, 0]]), (6, 5)), a)


def test_affine_columns(spark):
    m = [1.5, 0.2, 3.0, -0.1, 2.0, -4.0]
    df = spark.range(1)
    got = df.select(*geometry.affine_invert([F.lit(x) for x in m])).first()
    want = np.linalg.inv(np.vstack([np.array(m).reshape(2, 3), [0, 0, 1]]))[:2].ravel()
    assert np.allclose(list(got), want)


def test_blur_constants_identity_and_table(spark):
    assert np.allclose(raster.gaussian(np.full((9, 7), 3.0), 2), 3)
    a = np.random.default_rng(0).normal(size=(9, 12))
    assert raster.gaussian(a, 0) is a
    rows = [(0, r, c, float(a[r, c])) for r in range(9) for c in range(12)]
    df = spark.createDataFrame(rows, "k int, r int, c int, v double")
    out = np.zeros_like(a)
    for r in grids.blur(grids.blur(df, ["k"], "c", 12, 1.0), ["k"], "r", 9, 1.0).collect():
        out[r["r"], r["c"]] = r["v"]
    assert np.allclose(out, raster.gaussian(a, 1.0))


def test_resize_table_equals_kernel(spark):
    a = np.random.default_rng(0).normal(size=(4, 6))
    df = spark.createDataFrame([(0, r, c, float(a[r, c])) for r in range(4) for c in range(6)], "k int, r int, c int, v double")
    out = np.zeros((7, 9))
    for r in grids.resize(df, ["k"], (4, 6), (7, 9)).collect():
        out[r["y"], r["x"]] = r["v"]
    assert np.allclose(out, raster.resize(a, (9, 7)))


def test_principal_axis(spark):
    y, x = np.mgrid[0:40, 0:60]
    mask = (np.abs((x - 30) * np.sin(0.4) - (y - 20) * np.cos(0.4)) < 3) & (np.hypot(x - 30, y - 20) < 18)
    _, angle, major, minor = raster.principal_axis(mask)
    assert angle == pytest.approx(np.degrees(0.4), abs=1.0) and major > 3 * minor
    df = spark.createDataFrame([(1, int(a), int(b)) for b, a in zip(*np.nonzero(mask))], "k int, x int, y int")
    got = geometry.principal_axis(df, ["k"]).first()
    assert got["angle"] == pytest.approx(angle) and got["std_major"] == pytest.approx(major)


def test_degenerate_masks():
    small = np.zeros((20, 30))
    small[3, 3:12] = 1
    got = raster.aligned_crop(None, small, (28, 28))
    assert got["angle"] == 0 and got["iou"] == 0 and not got["mask"].any()
    assert raster.principal_axis(np.zeros((8, 4)))[0] == (2, 4)
    assert raster.iou(np.zeros(3), np.zeros(3)) == 0


def test_candidates():
    mask = np.zeros((40, 60))
    mask[18:22, 10:50] = 1
    one = raster.aligned_crop(None, mask, (28, 28), candidates=[90], reference=np.ones((28, 28)))
    assert one["angle"] == pytest.approx(0, abs=1e-9)  # a single candidate doesn't count
    tie = raster.aligned_crop(None, mask, (28, 28), candidates=[0, 360], reference=np.ones((28, 28)))
    assert tie["angle"] == pytest.approx(0, abs=1e-9)
    flat = raster.aligned_crop(None, mask, (28, 28), align=False, offset=30)
    assert flat["angle"] == 0 and flat["iou"] > 0


def test_colour_guide():
    """Edges that only a colour image shows guide the filter; a gray image guides as three equal channels would."""
    rng = np.random.default_rng(1)
    step = np.zeros((24, 24))
    step[:, 12:] = 1
    noisy = step + rng.normal(0, 0.1, step.shape)
    colour = np.where(step[..., None] > 0, [200, 100, 50], [100, 151, 50]).astype(np.uint8)  # of about the same gray
    flat = np.full((24, 24), 127, np.uint8)
    sharp, blurred = (raster.guided(noisy, g, 3, 1.0) for g in (colour, flat))
    edge = lambda a: abs(a[:, 12].mean() - a[:, 11].mean())
    assert edge(sharp) > 0.5 > edge(blurred)
    gray = rng.integers(0, 255, (24, 24)).astype(np.uint8)
    one = raster.guided(noisy, gray, 3, 3.0)
    three = raster.guided(noisy, np.repeat(gray[..., None], 3, axis=2), 3, 9.0)
    assert np.abs(one - three).max() <= 1 / 255 + 1e-9


def test_drawings():
    box = raster.crop_box(np.array([1.0, 0, -4, 0, 1.0, -2]), (9, 5), (20, 12))
    assert box.shape == (12, 20, 3) and box[2, 4].any() and box[6, 12].any() and not box[0, 0].any() and not box[11, 19].any()
    over = raster.overlay(np.full((8, 8), 100, np.uint8), np.arange(16.0).reshape(4, 4))
    assert over.shape == (8, 8, 3) and over[0, 0].tolist() == [40, 40, 42] and over[7, 7].sum() > over[0, 0].sum()


def test_per_defect(spark):
    rng = np.random.default_rng(2)
    rows = [("good", float(rng.integers(0, 40))) for _ in range(300)] + [(d, float(rng.integers(5, 50))) for d in "abc" for _ in range(50)] + [("d", 100.0)]
    got = {r["defect"]: r["auroc"] for r in metrics.per_defect(spark.createDataFrame(rows, "label string, score double"), "score", "label").collect()}
    normal = np.array([s for k, s in rows if k == "good"])
    for d in "abcd":
        own = np.array([s for k, s in rows if k == d])[:, None]
        assert got[d] == pytest.approx(((own > normal) + (own == normal) / 2).mean())
    assert set(got) == set("abcd")
    alone = metrics.per_defect(spark.createDataFrame(rows[300:], "label string, score double"), "score", "label").collect()
    assert {r["auroc"] for r in alone} == {None}


def test_refiners():
    a = np.random.default_rng(0).random((12, 12))
    assert raster.refiner({}, "raw") is None
    assert raster.refiner({}, "no such")(a, None) is a
    assert not raster.normalized(np.full((3, 3), 2.0)).any()
    assert set(np.unique(raster.refiner({"morph_threshold_pct": 50}, "morph")(a, None))) <= {0.0, 1.0}
    g = raster.refiner({}, "guided")(a, np.full((24, 24), 9, np.uint8))
    assert g.shape == a.shape and g.min() >= 0 and g.max() <= 1
    assert raster.refiner({}, "guided")(a, None) is a
    b = raster.refiner({}, "bilateral")(a, None)
    assert b.shape == a.shape and b.min() >= 0 and b.max() <= 1


def test_hashes():
    assert cfg.stage_hash({}, "embed") == "44136fa355b3678a"
    changed = cfg.merged(cfg.DEFAULTS, {"segmentation": {"prompts": ["x"]}})
    assert cfg.stage_hash(changed, "segment") != cfg.stage_hash(cfg.DEFAULTS, "segment")
    assert cfg.stage_hash(changed, "segment", compat=True) == cfg.stage_hash(cfg.DEFAULTS, "segment", compat=True)
    assert cfg.map_area([48, 24]) == 1152 and np.isnan(cfg.map_area([1]))
    with pytest.raises(ValueError):
        cfg.stage_hash({}, "none")
