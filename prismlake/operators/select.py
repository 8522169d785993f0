"""Choosing bank members."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capacity(max_gb: Column | float, h: Column | int, w: Column | int, c: Column | int, available: Column | int) -> Column:
    """How many instances of h x w x c two-byte numbers fit, at least 1 and at most those there are."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fits = F.floor(lit(max_gb).cast("double") * float(2**30) / (lit(h).cast("double") * lit(w) * lit(c) * 2))
    return F.greatest(F.lit(1), F.least(fits, lit(available).cast("long"))).cast("long")


def k_center(pooled: DataFrame, project: str, instance: str, vector: str, k: int) -> DataFrame:
    """Greedy k-center by cosine similarity: project, rank (from 1), instance.

    Starts with the smallest instance; each further pick is the one whose largest similarity to the picks so far
    is least, the smallest instance on ties. k is clipped to the instances there are. A project's pooled vectors
    (one for each instance) are one task, as each pick depends on all before it.
    """
    types = dict(pooled.dtypes)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(instance)
        m = np.array(group[vector].tolist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        chosen, best = [0], m @ m[0]
        best[0] = np.inf
        while len(chosen) < min(k, len(m)):
            new = int(best.argmin())
            chosen.append(new)
            best = np.maximum(best, m @ m[new])
            best[new] = np.inf
        return pd.DataFrame({project: group[project].iloc[0], "rank": range(1, len(chosen) + 1), instance: group[instance].to_numpy()[chosen]})

    return pooled.select(project, instance, vector).groupBy(project).applyInPandas(pick, f"{project} {types[project]}, rank int, {instance} {types[instance]}")


def drawn(seed: int, *columns: str) -> Column:
    """What random choices are ordered by: the MD5 of the seed and some columns, which any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def random_k(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows by the least seeded hash of their key: without replacement, the same on every run."""
    if k > rows.count():
        raise ValueError("more rows asked for than there are")
    return rows.orderBy(drawn(seed, key), key).limit(k)


def sample_per_group(rows: DataFrame, group: list[str], key: list[str], k: int | None, seed: int = 0) -> DataFrame:
    """At most k rows of each group by the least seeded hash; all for none or k <= 0."""
    if not k or k <= 0:
        return rows
    order = Window.partitionBy(*group).orderBy(drawn(seed, *group, *key), *key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
