"""Scores and their evaluation as aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score ranges of the two-level running sums.
RANGES = 128


def is_finite(c: Column | str) -> Column:
    """Neither null nor NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def percentile_of(ordered: Column, share: float) -> Column:
    """Linearly interpolated percentile of a sorted array without nulls; between equal values it is that value, unrounded."""
    at = F.lit(share) * (F.size(ordered) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, high)
    return F.when(below == above, below).otherwise((high - at) * below + (at - low) * above)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_sum(x: Column) -> Column:
    """Sum of an array of doubles; what each addition rounds off is added at the end, so the order doesn't matter."""

    def add(acc: Column, y: Column) -> Column:
        s = acc["s"]
        t = s + y
        return F.struct(t.alias("s"), (acc["c"] + ((s - (t - (t - s))) + (y - (t - s)))).alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    return F.aggregate(x, zero, add, lambda acc: acc["s"] + F.nanvl(acc["c"], F.lit(0.0)))  # the rest of an infinite sum is NaN


def band_of(values: Column | str, low: float, high: float, method: str = "mean") -> Column:
    """Score of an array: the mean, max or sum (else the mean) of the values between two percentiles, both included.

    Without values in the band those from the lower percentile on count, without these all. A raster with a NaN
    scores NaN, as its percentiles are unknown and its mean is NaN; one without values scores null.
    """

    def score(v: Column) -> Column:
        bounds = F.struct(percentile_of(v, low / 100).alias("lo"), percentile_of(v, high / 100).alias("hi"))
        found = let(bounds, lambda b: let(F.filter(v, lambda x: (x >= b["lo"]) & (x <= b["hi"])), lambda inside: or_else(inside, let(F.filter(v, lambda x: x >= b["lo"]), lambda above: or_else(above, total(v))))))
        return F.when(F.size(v) < 1, F.lit(None).cast("double")).when(F.isnan(F.get(v, F.size(v) - 1)), F.lit(float("nan"))).otherwise(found)

    def total(x: Column) -> Column:
        added = exact_sum(x)
        return {"max": F.array_max(x), "sum": added}.get(method, added / F.size(x))

    def or_else(x: Column, other: Column) -> Column:
        return F.when(F.size(x) > 0, total(x)).otherwise(other)

    return let(F.array_sort(F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: x.isNotNull())), score)  # NaN comes last


def band_score(values: DataFrame, keys: list[str], value: str, low: float, high: float, method: str = "mean") -> DataFrame:
    """By keys the band score, as in band_of(), of a column's values, which are collected once: a raster each."""
    return values.groupBy(*keys).agg(F.collect_list(value).alias("_values")).select(*keys, band_of("_values", low, high, method).alias("score"))


def thresholds(rows: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """For each distinct score, from the highest on: p and n (positives, negatives) and their running sums tp and fp.

    Rows are first aggregated by score. The running sums have two levels, so that no task gets all scores:
    within ranges of scores, and over the ranges' totals (at most RANGES for each group).
    """
    by = by or []
    counts = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    edges = counts.select(F.percentile_approx("s", F.lit([i / RANGES for i in range(1, RANGES)]))).scalar()
    ranged = counts.withColumn("_e", edges).withColumn("_r", F.size(F.filter("_e", lambda e: e <= F.col("s")))).drop("_e")
    totals = ranged.groupBy(*by, "_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_r", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_p", "_n")))
    within = Window.partitionBy(*by, "_r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, [*by, "_r"]).select(
        *by, "s", "p", "n", (F.sum("p").over(within) + F.col("_p")).alias("tp"), (F.sum("n").over(within) + F.col("_n")).alias("fp")
    )


def auroc() -> Column:
    """Area under the ROC curve from thresholds(); null with one class only."""
    both = (F.sum("p") > 0) & (F.sum("n") > 0)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / (F.sum("p").cast("double") * F.sum("n"))
    return F.when(both, area)


def average_precision() -> Column:
    """Sum of the recall's steps times precision from thresholds(); null with one class only."""
    both = (F.sum("p") > 0) & (F.sum("n") > 0)
    return F.when(both, F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p"))


def per_defect(rows: DataFrame, score: str, label: str, good: str = "good") -> DataFrame:
    """AUROC of each label other than good against all good rows; (defect, auroc), null without good rows.

    Each defect score's share of lower good scores (half of equal ones) is read off the thresholds of all rows, so
    good rows aren't dealt out to the defects, and no task gets all of them.
    """
    curve = thresholds(rows, score, F.col(label) != good)
    total = rows.agg(F.count_if(F.col(label) == good)).scalar()
    own = rows.where(F.col(label) != good).groupBy(F.col(label).alias("defect"), F.col(score).alias("s")).agg(F.count("*").alias("k"))
    placed = own.join(curve.select("s", "n", "fp"), "s").withColumn("_good", total)
    lower = F.sum(F.col("k") * (F.col("_good") - F.col("fp") + F.col("n") / 2.0))
    return placed.groupBy("defect", "_good").agg(F.when(F.col("_good") > 0, lower / (F.sum("k").cast("double") * F.col("_good"))).alias("auroc")).select("defect", "auroc")


def moments(rows: DataFrame, score: str, anomalous: Column) -> DataFrame:
    """Mean, population deviation and extremes of normal and anomalous scores, and their separation."""
    s = F.col(score)
    n, a = F.when(~anomalous, s), F.when(anomalous, s)
    out = rows.agg(
        F.avg(n).alias("normal_mean"), F.stddev_pop(n).alias("normal_std"), F.max(n).alias("normal_max"),
        F.avg(a).alias("anomaly_mean"), F.stddev_pop(a).alias("anomaly_std"), F.min(a).alias("anomaly_min"),
    )
    return out.withColumn("separation", F.col("anomaly_mean") - F.col("normal_mean"))


def defect_column(label: Column | str) -> Column:
    """The run log's column name of a defect."""
    return F.concat(F.lit("auroc_"), F.translate(label, ", ", "__"))
