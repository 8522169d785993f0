"""Affine maps (six doubles, row by row) and mask moments as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def affine_invert(m: list[Column]) -> list[Column]:
    a, b, c, d, e, f = m
    det = a * e - b * d
    ia, ib, id_, ie = e / det, -b / det, -d / det, a / det
    return [ia, ib, -(ia * c + ib * f), id_, ie, -(id_ * c + ie * f)]


def affine_apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def rotation(mean_x: Column, mean_y: Column, degrees: Column, scale: Column, out_w: Column, out_h: Column) -> list[Column]:
    """Rotate about the mean, scale, and move the mean to the output's centre."""
    alpha, beta = scale * F.cos(F.radians(degrees)), scale * F.sin(F.radians(degrees))
    return [alpha, beta, (1 - alpha) * mean_x - beta * mean_y + out_w / 2 - mean_x, -beta, alpha, beta * mean_x + (1 - alpha) * mean_y + out_h / 2 - mean_y]


def aspect_fit(w: Column, h: Column, out_w: Column, out_h: Column) -> list[Column]:
    """Scale so that the output is covered, centred."""
    s = F.when(w / h < out_w / out_h, out_w / w).otherwise(out_h / h)
    return [s, F.lit(0.0), (out_w - w * s) / 2, F.lit(0.0), s, (out_h - h * s) / 2]


def principal_axis(pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """By keys the mask's mean, its main axis' angle in degrees in (-90, 90] and its deviation along both axes.

    Below five pixels the angle is 0 and the deviations are null.
    """
    m = pixels.groupBy(*keys).agg(
        F.count("*").alias("area"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("sxx"), F.covar_samp(x, y).alias("sxy"), F.var_samp(y).alias("syy"),
    )
    mid, spread = (F.col("sxx") + F.col("syy")) / 2, F.sqrt(F.pow((F.col("sxx") - F.col("syy")) / 2, F.lit(2.0)) + F.col("sxy") * F.col("sxy"))
    angle = F.degrees(F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2)
    enough = F.col("area") >= 5
    return m.select(
        *keys, "area", "mean_x", "mean_y", F.when(enough, angle).otherwise(0.0).alias("angle"),
        F.when(enough, F.sqrt(mid + spread)).alias("std_major"), F.when(enough, F.sqrt(F.greatest(mid - spread, F.lit(0.0)))).alias("std_minor"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two flags as an aggregate; 0 where the union is empty."""
    union = F.count_if(a | b)
    return F.when(union > 0, F.count_if(a & b) / union).otherwise(0.0)
