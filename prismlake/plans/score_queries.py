"""Queries on scores: bands, moments, ROC, per-defect reports, run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.functions import metrics
from prismlake.operators import heatmap

from .registry import query, table


def _band(method: str, low: float, high: float, kind: str) -> str:
    return f"""WITH b AS (SELECT user_id, quantile_cont(value, {low / 100}) AS lo, quantile_cont(value, {high / 100}) AS hi FROM events GROUP BY user_id),
      a AS (SELECT user_id, {kind}(value) FILTER (value BETWEEN lo AND hi) AS x, {kind}(value) FILTER (value >= lo) AS y, {kind}(value) AS z FROM events JOIN b USING (user_id) GROUP BY user_id)
      SELECT user_id, round(coalesce(x, y, z), 5) AS score FROM a"""


def _scored(spark, sf_dir, low, high, method):
    return metrics.band_score(table(spark, sf_dir, "events"), ["user_id"], "value", low, high, method).withColumn("score", F.round("score", 5))


@query(_band("mean", 60, 95, "avg"))
def band_mean(spark, sf_dir):
    return _scored(spark, sf_dir, 60, 95, "mean")


@query(_band("max", 60, 95, "max"))
def band_max(spark, sf_dir):
    return _scored(spark, sf_dir, 60, 95, "max")


@query(_band("sum", 60, 95, "sum"))
def band_sum(spark, sf_dir):
    return _scored(spark, sf_dir, 60, 95, "sum")


@query(_band("median", 99.9, 99.999, "avg"))
def band_fallback(spark, sf_dir):
    """Narrow bands are empty for small groups; an unknown method counts as mean."""
    return _scored(spark, sf_dir, 99.9, 99.999, "median")


@query("""WITH m AS (SELECT avg(value) FILTER (event_type <> 'error') AS normal_mean, stddev_pop(value) FILTER (event_type <> 'error') AS normal_std, max(value) FILTER (event_type <> 'error') AS normal_max,
    avg(value) FILTER (event_type = 'error') AS anomaly_mean, stddev_pop(value) FILTER (event_type = 'error') AS anomaly_std, min(value) FILTER (event_type = 'error') AS anomaly_min FROM events)
  SELECT round(normal_mean, 5) AS normal_mean, round(normal_std, 5) AS normal_std, round(normal_max, 5) AS normal_max, round(anomaly_mean, 5) AS anomaly_mean, round(anomaly_std, 5) AS anomaly_std,
    round(anomaly_min, 5) AS anomaly_min, round(anomaly_mean - normal_mean, 5) AS separation FROM m""")
def moments_separation(spark, sf_dir):
    m = metrics.moments(table(spark, sf_dir, "events"), "value", F.col("event_type") == "error")
    return m.select(*(F.round(c, 5).alias(c) for c in m.columns))


_ROC = """t AS (SELECT s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM scored GROUP BY s),
  c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM t)"""


@query(f"""WITH scored AS (SELECT value AS s, event_type = 'error' AS pos FROM events), {_ROC}
  SELECT round(sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)), 6) AS auroc FROM c""")
def roc_auc(spark, sf_dir):
    t = metrics.thresholds(table(spark, sf_dir, "events"), "value", F.col("event_type") == "error")
    return t.agg(F.round(metrics.auroc(), 6).alias("auroc"))


@query(f"""WITH scored AS (SELECT n_chars AS s, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), {_ROC}
  SELECT round(sum(p * tp::DOUBLE / (tp + fp)) / sum(p), 6) AS ap FROM c""")
def average_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.thresholds(rows, "n_chars", F.col("quality") == 1).agg(F.round(metrics.average_precision(), 6).alias("ap"))


@query("""WITH scored AS (SELECT user_id % 7 AS g, value AS s, event_type = 'error' AS pos FROM events),
  t AS (SELECT g, s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM scored GROUP BY g, s),
  c AS (SELECT *, sum(p) OVER (PARTITION BY g ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY g ORDER BY s DESC) AS fp FROM t)
  SELECT g, round(sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)), 6) AS auroc, round(sum(p * tp::DOUBLE / (tp + fp)) / sum(p), 6) AS ap FROM c GROUP BY g""")
def roc_by_project(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 7)
    t = metrics.thresholds(rows, "value", F.col("event_type") == "error", ["g"])
    return t.groupBy("g").agg(F.round(metrics.auroc(), 6).alias("auroc"), F.round(metrics.average_precision(), 6).alias("ap"))


_DEFECT = """d AS (SELECT DISTINCT event_type AS defect FROM events WHERE event_type <> 'view'),
  r AS (SELECT event_type AS defect, value AS s, 1 AS y FROM events WHERE event_type <> 'view' UNION ALL SELECT defect, value, 0 FROM events, d WHERE event_type = 'view'),
  t AS (SELECT defect, s, sum(y) AS p, sum(1 - y) AS n FROM r GROUP BY defect, s),
  c AS (SELECT *, sum(p) OVER (PARTITION BY defect ORDER BY s DESC) AS tp FROM t),
  a AS (SELECT defect, round(sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)), 6) AS auroc FROM c GROUP BY defect)"""


@query(f"WITH {_DEFECT} SELECT * FROM a")
def per_defect_auroc(spark, sf_dir):
    return metrics.per_defect(table(spark, sf_dir, "events"), "value", "event_type", "view").withColumn("auroc", F.round("auroc", 6))


@query(f"WITH {_DEFECT} SELECT " + ", ".join(f"max(auroc) FILTER (defect = '{d}') AS auroc_{d}" for d in ("click", "error", "purchase", "signup")) + " FROM a")
def defect_pivot(spark, sf_dir):
    found = per_defect_auroc(spark, sf_dir).withColumn("column", metrics.defect_column("defect"))
    return found.groupBy().pivot("column", [f"auroc_{d}" for d in ("click", "error", "purchase", "signup")]).agg(F.max("auroc"))


@query("SELECT p_partkey, 'auroc_' || replace(replace(p_name || ', ' || p_type, ',', '_'), ' ', '_') AS c FROM part")
def defect_column_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", metrics.defect_column(F.concat_ws(", ", "p_name", "p_type")).alias("c"))


@query("""WITH s AS (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 7 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS s FROM events)
  SELECT event_type, count(*)::BIGINT AS n, round(sum(s), 4) AS total FROM s WHERE isfinite(s) GROUP BY event_type""")
def finite_filter(spark, sf_dir):
    i = F.col("event_id")
    s = F.when(i % 5 == 0, F.lit(float("nan"))).when(i % 7 == 0, F.lit(float("inf"))).when(i % 11 == 0, None).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").withColumn("s", s).where(metrics.is_finite("s"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("total"))


@query("SELECT user_id, greatest(0, max(value - 50)) AS v FROM events GROUP BY user_id")
def composite_max(spark, sf_dir):
    return heatmap.composite(table(spark, sf_dir, "events").withColumn("v", F.col("value") - 50), ["user_id"], "v")


@query("""WITH r AS (SELECT event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id))
  SELECT event_id, round(CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS v FROM r""")
def minmax_normalize(spark, sf_dir):
    return heatmap.minmax(table(spark, sf_dir, "events"), ["user_id"], "value").select("event_id", F.round("value", 6).alias("v"))


_CHANNELS = [(0.485, 0.229), (0.456, 0.224), (0.406, 0.225)]


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((l_quantity / 255::DOUBLE - {m}::DOUBLE) / {s}::DOUBLE, 6) AS c{i}" for i, (m, s) in enumerate(_CHANNELS)) + " FROM lineitem")
def pixel_norm(spark, sf_dir):
    """Model input: a byte's share, less the channel's mean, over its deviation."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *(F.round((F.col("l_quantity") / 255.0 - m) / s, 6).alias(f"c{i}") for i, (m, s) in enumerate(_CHANNELS))
    )


@query("SELECT event_id, (value > 127)::INTEGER AS strong, CASE WHEN value > 0 THEN 255 ELSE 0 END AS mask FROM events")
def threshold_binarize(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (v > 127).cast("int").alias("strong"), F.when(v > 0, 255).otherwise(0).alias("mask"))


@query("""WITH p AS (SELECT user_id, quantile_cont(value, 0.95) AS t FROM events GROUP BY user_id)
  SELECT event_id, (value > t)::INTEGER AS hit FROM events JOIN p USING (user_id)""")
def morph_threshold(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    limits = events.groupBy("user_id").agg(F.percentile("value", F.lit(0.95)).alias("t"))
    return events.join(limits, "user_id").select("event_id", (F.col("value") > F.col("t")).cast("int").alias("hit"))


@query("""SELECT 'a' AS run_id, o_orderkey AS id, o_totalprice AS auroc_x, NULL::VARCHAR AS mode FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'b', o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1""")
def runs_union(spark, sf_dir):
    """Run logs with different columns in one, by name."""
    orders = table(spark, sf_dir, "orders")
    a = orders.where("o_orderkey % 2 = 0").select(F.lit("a").alias("run_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("auroc_x"))
    b = orders.where("o_orderkey % 2 = 1").select(F.lit("b").alias("run_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("mode"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT coalesce(o_orderstatus, 'all') AS split, coalesce(o_orderpriority, 'all') AS label, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def sum_by_split_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return orders.select(F.coalesce("o_orderstatus", F.lit("all")).alias("split"), F.coalesce("o_orderpriority", F.lit("all")).alias("label"), "n", "total")


_GRID = "SELECT (extract(hour FROM ts))::INTEGER AS r, (event_id % 16)::INTEGER AS c, count(*)::DOUBLE AS v FROM events GROUP BY ALL"


@query(f"""WITH heat AS ({_GRID}), gt AS (SELECT r, c, v > 28 AS y FROM heat WHERE r > 1),
  scored AS (SELECT h.v + (h.r * 7 + h.c) % 5 AS s, y AS pos FROM heat h JOIN gt USING (r, c)), {_ROC}
  SELECT round(sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)), 6) AS auroc, sum(p)::BIGINT AS n_positive, sum(p + n)::BIGINT AS n_pixels FROM c""")
def pixel_auroc_exact(spark, sf_dir):
    """Ground truth joined with the heatmap by pixel, AUROC over all pixels."""
    heat = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("r"), (F.col("event_id") % 16).cast("int").alias("c")).agg(F.count("*").cast("double").alias("v"))
    gt = heat.where("r > 1").select("r", "c", (F.col("v") > 28).alias("y"))
    rows = heat.join(gt, ["r", "c"]).withColumn("s", F.col("v") + (F.col("r") * 7 + F.col("c")) % 5)
    t = metrics.thresholds(rows, "s", F.col("y"))
    return t.agg(F.round(metrics.auroc(), 6).alias("auroc"), F.sum("p").alias("n_positive"), F.sum(F.col("p") + F.col("n")).alias("n_pixels"))


@query(f"""WITH heat AS ({_GRID}), gt AS (SELECT r, c, (v > 28)::INTEGER AS y FROM heat WHERE r > 1)
  SELECT h.r, h.c, h.v, y FROM heat h JOIN gt USING (r, c)""")
def gt_pixel_join(spark, sf_dir):
    """Ground truth and heatmap by pixel; images without ground truth are left out."""
    heat = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("r"), (F.col("event_id") % 16).cast("int").alias("c")).agg(F.count("*").cast("double").alias("v"))
    return heat.join(heat.where("r > 1").select("r", "c", (F.col("v") > 28).cast("int").alias("y")), ["r", "c"])


@query("""SELECT 'train' AS split, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'test', o_orderkey FROM orders WHERE o_orderstatus <> 'O'""")
def union_splits(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    part = lambda name, rows: rows.select(F.lit(name).alias("split"), F.col("o_orderkey").alias("id"))
    return part("train", orders.where("o_orderstatus = 'O'")).unionAll(part("test", orders.where("o_orderstatus <> 'O'")))
