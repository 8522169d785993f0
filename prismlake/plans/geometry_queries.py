"""Queries on crop geometry and small rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.functions import geometry
from prismlake.operators import grids

from .registry import query, table


@query("""SELECT l_returnflag, count(*)::BIGINT AS area, round(avg(l_quantity), 6) AS mean_x,
  round(degrees(atan2(2 * covar_samp(l_quantity, l_discount * 100), var_samp(l_quantity) - var_samp(l_discount * 100)) / 2), 4) AS angle,
  round(sqrt((var_samp(l_quantity) + var_samp(l_discount * 100)) / 2 + sqrt(pow((var_samp(l_quantity) - var_samp(l_discount * 100)) / 2, 2) + pow(covar_samp(l_quantity, l_discount * 100), 2))), 4) AS std_major FROM lineitem GROUP BY l_returnflag""")
def pca_angle(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_discount") * 100)
    axis = geometry.principal_axis(rows, ["l_returnflag"], "l_quantity", "y")
    return axis.select("l_returnflag", "area", F.round("mean_x", 6).alias("mean_x"), F.round("angle", 4).alias("angle"), F.round("std_major", 4).alias("std_major"))


@query("""SELECT l_orderkey, round(CASE WHEN count(*) FILTER (l_quantity > 25 OR l_tax > 0.04) > 0 THEN count(*) FILTER (l_quantity > 25 AND l_tax > 0.04)::DOUBLE / count(*) FILTER (l_quantity > 25 OR l_tax > 0.04) ELSE 0 END, 6) AS iou
  FROM lineitem GROUP BY l_orderkey""")
def iou(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(geometry.iou(F.col("l_quantity") > 25, F.col("l_tax") > 0.04), 6).alias("iou"))


@query("SELECT l_orderkey, round(CASE WHEN sum(l_quantity) > 0 THEN sum(l_quantity * (1 - l_discount)) / sum(l_quantity) ELSE 0 END + 1e-9::DOUBLE, 4) AS ratio FROM lineitem GROUP BY l_orderkey")
def area_ratio(spark, sf_dir):
    total = F.sum("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.when(total > 0, F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))) / total).otherwise(0.0) + 1e-9, 4).alias("ratio"))


@query("SELECT l_orderkey, arg_max(l_linenumber, l_quantity * 100 - l_linenumber) AS candidate FROM lineitem GROUP BY l_orderkey")
def orientation_argmax(spark, sf_dir):
    """The candidate of the largest overlap, the earliest on ties."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("candidate"))


_M = "1 + p_size / 10.0::DOUBLE AS a, 0.25::DOUBLE AS b, p_size::DOUBLE AS c, -0.5::DOUBLE AS d, 2 + p_size / 20.0::DOUBLE AS e, p_retailprice / 100 AS f"


def _matrix():
    s = F.col("p_size")
    return [1 + s / 10.0, F.lit(0.25), s.cast("double"), F.lit(-0.5), 2 + s / 20.0, F.col("p_retailprice") / 100]


@query(f"WITH m AS (SELECT p_partkey, {_M} FROM part), i AS (SELECT *, a * e - b * d AS t FROM m) SELECT p_partkey, round(e / t, 6) AS m0, round(-b / t, 6) AS m1, round(-(e / t * c + -b / t * f), 6) AS m2, round(-d / t, 6) AS m3, round(a / t, 6) AS m4, round(-(-d / t * c + a / t * f), 6) AS m5 FROM i")
def affine_invert(spark, sf_dir):
    inverse = geometry.affine_invert(_matrix())
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(x, 6).alias(f"m{i}") for i, x in enumerate(inverse)))


@query(f"WITH m AS (SELECT p_partkey, {_M} FROM part), i AS (SELECT *, a * e - b * d AS t FROM m) SELECT p_partkey, x::INTEGER AS x, y::INTEGER AS y, round(e / t * x - b / t * y - (e / t * c - b / t * f), 6) AS u, round(-d / t * x + a / t * y - (-d / t * c + a / t * f), 6) AS v FROM i, (VALUES (0, 0), (672, 0), (672, 672), (0, 672)) k(x, y)")
def affine_corners(spark, sf_dir):
    """The crop's corners in the original image."""
    corners = F.inline(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (672, 0), (672, 672), (0, 672)))))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", corners)
    u, v = geometry.affine_apply(geometry.affine_invert(_matrix()), F.col("x"), F.col("y"))
    return rows.select("p_partkey", "x", "y", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("""WITH r AS (SELECT p_partkey, p_size * 1.0::DOUBLE AS mx, p_retailprice / 10 AS my, 2.5 * cos(radians(p_size * 7.0::DOUBLE)) AS al, 2.5 * sin(radians(p_size * 7.0::DOUBLE)) AS be FROM part)
  SELECT p_partkey, round(al, 6) AS m0, round(be, 6) AS m1, round((1 - al) * mx - be * my + 336 - mx, 5) AS m2, round(-be, 6) AS m3, round(al, 6) AS m4, round(be * mx + (1 - al) * my + 336 - my, 5) AS m5 FROM r""")
def rotation_matrix(spark, sf_dir):
    m = geometry.rotation(F.col("p_size") * 1.0, F.col("p_retailprice") / 10, F.col("p_size") * 7.0, F.lit(2.5), F.lit(672), F.lit(672))
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(x, 5 if i in (2, 5) else 6).alias(f"m{i}") for i, x in enumerate(m)))


@query("""WITH s AS (SELECT p_partkey, p_size * 20.0::DOUBLE AS w, p_retailprice AS h, CASE WHEN p_size * 20.0::DOUBLE / p_retailprice < 1 THEN 672 / (p_size * 20.0::DOUBLE) ELSE 672 / p_retailprice END AS s FROM part)
  SELECT p_partkey, round(s, 6) AS scale, round((672 - w * s) / 2, 5) + 0.0::DOUBLE AS dx, round((672 - h * s) / 2, 5) + 0.0::DOUBLE AS dy FROM s""")
def aspect_fit(spark, sf_dir):
    m = geometry.aspect_fit(F.col("p_size") * 20.0, F.col("p_retailprice"), F.lit(672.0), F.lit(672.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(m[0], 6).alias("scale"), (F.round(m[2], 5) + 0.0).alias("dx"), (F.round(m[5], 5) + 0.0).alias("dy"))


@query("""WITH a AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS area FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, CASE WHEN area < 2 THEN 'fit' WHEN area < 5 THEN 'plain' ELSE 'pca' END AS path FROM a""")
def degenerate_masks(spark, sf_dir):
    areas = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("area"))
    return areas.select("l_orderkey", F.when(F.col("area") < 2, "fit").when(F.col("area") < 5, "plain").otherwise("pca").alias("path"))


_GRID = "grid AS (SELECT user_id % 5 AS img, r::INTEGER AS r, c::INTEGER AS c, v FROM (SELECT user_id % 5 AS user_id, extract(hour FROM ts) % 12 AS r, event_id % 10 AS c, count(*)::DOUBLE AS v FROM events GROUP BY ALL)), dims AS (SELECT DISTINCT img FROM grid), full_grid AS (SELECT d.img, a.r::INTEGER AS r, b.c::INTEGER AS c, coalesce(g.v, 0) AS v FROM dims d, range(0, 12) a(r), range(0, 10) b(c) LEFT JOIN grid g ON g.img = d.img AND g.r = a.r AND g.c = b.c)"
_GRID = _GRID.replace("user_id % 5 AS img, r::INTEGER", "user_id AS img, r::INTEGER")


def grid(spark, sf_dir):
    """Five 12 x 10 images of event counts."""
    cells = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("img"), (F.hour("ts") % 12).cast("int").alias("r"), (F.col("event_id") % 10).cast("int").alias("c")).agg(F.count("*").cast("double").alias("v"))
    return grids.filled(cells, ["img"], 12, 10)


def _taps(sigma: float) -> str:
    return ", ".join(f"({o}, {g!r}::DOUBLE)" for o, g in grids.gaussian(sigma))


@query(f"""WITH {_GRID}, k(o, g) AS (VALUES {_taps(1.0)}) SELECT img, s.r, a.c, round(sum(g * v), 6) AS v FROM (SELECT DISTINCT img, c FROM full_grid) a JOIN k ON true
  JOIN full_grid s USING (img) WHERE s.c = 9 - abs(9 - abs(a.c + o)) GROUP BY img, s.r, a.c""")
def gaussian_blur_1d(spark, sf_dir):
    return grids.blur(grid(spark, sf_dir), ["img"], "c", 10, 1.0).withColumn("v", F.round("v", 6))


@query(f"""WITH {_GRID}, k(o, g) AS (VALUES {_taps(1.5)}), x AS (SELECT img, s.r, a.c, sum(g * v) AS v FROM (SELECT DISTINCT img, c FROM full_grid) a JOIN k ON true JOIN full_grid s USING (img) WHERE s.c = 9 - abs(9 - abs(a.c + o)) GROUP BY img, s.r, a.c)
  SELECT img, a.r, s.c, round(sum(g * v), 5) AS v FROM (SELECT DISTINCT img, r FROM x) a JOIN k ON true JOIN x s USING (img) WHERE s.r = 11 - abs(11 - abs(a.r + o)) GROUP BY img, a.r, s.c""")
def gaussian_blur_2d(spark, sf_dir):
    across = grids.blur(grid(spark, sf_dir), ["img"], "c", 10, 1.5)
    return grids.blur(across, ["img"], "r", 12, 1.5).withColumn("v", F.round("v", 5))


@query(f"""WITH {_GRID}, o AS (SELECT y::INTEGER AS y, x::INTEGER AS x, greatest((y + 0.5::DOUBLE) * 12 / 20 - 0.5, 0) AS sy, greatest((x + 0.5::DOUBLE) * 10 / 15 - 0.5, 0) AS sx FROM range(0, 20) a(y), range(0, 15) b(x)),
  n AS (SELECT y, x, least(floor(sy) + dy, 11)::INTEGER AS r, least(floor(sx) + dx, 9)::INTEGER AS c, (CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w FROM o, (VALUES (0), (1)) p(dy), (VALUES (0), (1)) q(dx))
  SELECT img, y, x, round(sum(w * v), 6) AS v FROM n JOIN full_grid USING (r, c) GROUP BY img, y, x""")
def resize_bilinear(spark, sf_dir):
    return grids.resize(grid(spark, sf_dir), ["img"], (12, 10), (20, 15)).withColumn("v", F.round("v", 6))


@query(f"""WITH {_GRID} SELECT a.img, a.r, a.c, min(b.v) AS eroded, max(b.v) AS dilated FROM full_grid a JOIN full_grid b ON a.img = b.img AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY ALL""")
def erode_dilate(spark, sf_dir):
    return grids.erode_dilate(grid(spark, sf_dir), ["img"], 3)
