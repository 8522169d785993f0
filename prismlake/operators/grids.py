"""Raster operators on pixel tables (keys, r, c, v), as gather joins over a few neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filled(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Every pixel of every raster, 0 where there is none."""
    places = cells.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c"))
    return places.join(cells, [*keys, "r", "c"], "left").fillna(0.0, ["v"])


def gaussian(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of a kernel of int(4 sigma) | 1 taps."""
    half = (int(4 * sigma) | 1) // 2
    weights = [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-half, half + 1)]
    return [(o, w / sum(weights)) for o, w in zip(range(-half, half + 1), weights)]


def blur(pixels: DataFrame, keys: list[str], axis: str, size: int, sigma: float) -> DataFrame:
    """Gaussian blur along one axis with mirrored borders; every pixel gathers from the taps around it."""
    if sigma <= 0:
        return pixels
    other = "c" if axis == "r" else "r"
    # a source pixel gives to the places whose mirrored taps hit it
    taps: dict[int, list[tuple[int, float]]] = {}
    for place in range(size):
        for o, g in gaussian(sigma):
            source = (size - 1) - abs((size - 1) - abs(place + o)) if size > 1 else 0
            taps.setdefault(source, []).append((place, g))
    table = F.create_map(*(x for s, to in taps.items() for x in (F.lit(s), F.array(*(F.struct(F.lit(p).alias("_p"), F.lit(g).alias("_g")) for p, g in to)))))
    given = pixels.select(*keys, other, "v", F.inline(F.try_element_at(table, F.col(axis))))
    return given.groupBy(*keys, other, F.col("_p").alias(axis)).agg(F.sum(F.col("v") * F.col("_g")).alias("v"))


def resize(pixels: DataFrame, keys: list[str], size: tuple[int, int], out: tuple[int, int]) -> DataFrame:
    """Bilinear, half-pixel centres, clamped borders: (keys, y, x, v)."""

    def axis(n: int, m: int) -> list[tuple[int, int, float]]:
        rows = []
        for place in range(m):
            at = max((place + 0.5) * n / m - 0.5, 0.0)
            low = int(at)
            rows += [(place, min(low, n - 1), 1 - (at - low)), (place, min(low + 1, n - 1), at - low)]
        return rows

    spark = pixels.sparkSession
    ys = spark.createDataFrame(axis(size[0], out[0]), "y int, r int, wy double")
    xs = spark.createDataFrame(axis(size[1], out[1]), "x int, c int, wx double")
    joined = pixels.join(F.broadcast(ys), "r").join(F.broadcast(xs), "c")  # two rows for each output row or column
    return joined.groupBy(*keys, "y", "x").agg(F.sum(F.col("v") * F.col("wy") * F.col("wx")).alias("v"))


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element."""
    half = size // 2
    inside = []
    for dy in range(-half, size - half):
        reach = int(round(half * math.sqrt(max(0.0, 1 - (dy / half) ** 2)))) if half else 0
        inside += [(dy, dx) for dx in range(-reach, reach + 1)]
    return inside


def erode_dilate(pixels: DataFrame, keys: list[str], size: int) -> DataFrame:
    """eroded and dilated: least and largest value below the structuring element, within the raster."""
    offsets = F.inline(F.array(*(F.struct(F.lit(y).alias("_y"), F.lit(x).alias("_x")) for y, x in ellipse(size))))
    spread = pixels.select(*keys, "r", "c", "v", offsets).select(*keys, (F.col("r") + F.col("_y")).alias("r"), (F.col("c") + F.col("_x")).alias("c"), "v")
    seen = spread.groupBy(*keys, "r", "c").agg(F.min("v").alias("eroded"), F.max("v").alias("dilated"))
    return pixels.select(*keys, "r", "c").join(seen, [*keys, "r", "c"])
