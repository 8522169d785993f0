"""Queries on configuration and stage state."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from prismlake import config as cfg

from .registry import query

_CASES = [("a", {}), ("b", {"refine": {"gaussian_sigma": 3}}), ("c", {"crop": {"scale": 0.9}})]


def _rows() -> list[tuple[str, str, int, str]]:
    """Project, stage, its order and the JSON of its parameters."""
    out = []
    for project, over in _CASES:
        conf = cfg.merged(cfg.DEFAULTS, over)
        out += [(project, s, i, json.dumps({p: cfg.value(conf, p) for p in cfg.parameters(s)}, sort_keys=True)) for i, s in enumerate(cfg.STAGES)]
    return out


_VALUES = "v(project, stage, pos, doc) AS (VALUES " + ", ".join(f"('{p}', '{s}', {i}, '{d}')" for p, s, i, d in _rows()) + ")"


@query(f"WITH {_VALUES} SELECT project, stage, substr(sha256(doc), 1, 16) AS hash FROM v")
def config_hash(spark, sf_dir):
    rows = spark.createDataFrame(_rows(), "project string, stage string, pos int, doc string")
    return rows.select("project", "stage", F.substring(F.sha2("doc", 256), 1, 16).alias("hash"))


@query(f"""WITH {_VALUES}, h AS (SELECT *, sha256(doc) AS h FROM v), stored AS (SELECT stage, h FROM h WHERE project = 'a'),
  first AS (SELECT project, min(pos) AS pos FROM h JOIN stored USING (stage) WHERE h.h <> stored.h GROUP BY project)
  SELECT h.project, stage FROM h JOIN first ON first.project = h.project AND h.pos >= first.pos""")
def stale_stages(spark, sf_dir):
    """From the first stage whose hash differs from the stored one, all stages."""
    rows = spark.createDataFrame(_rows(), "project string, stage string, pos int, doc string").withColumn("h", F.sha2("doc", 256))
    stored = rows.where("project = 'a'").select("stage", F.col("h").alias("was"))
    first = rows.join(stored, "stage").where("h <> was").groupBy("project").agg(F.min("pos").alias("from"))
    return rows.join(first, "project").where(F.col("pos") >= F.col("from")).select("project", "stage")


@query("""SELECT user_id % 3 AS k, (json_extract_string(props, '$.k') IS NULL)::BOOLEAN AS missing, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def dotted_lookup(spark, sf_dir):
    """A path that a document lacks gives null."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy((F.col("user_id") % 3).alias("k"), F.get_json_object("props", "$.k").isNull().alias("missing")).agg(F.count("*").alias("n"))
