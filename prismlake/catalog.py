"""Where a project's tables are, and which stages are up to date."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as cfg
from . import schemas

ARTIFACTS = {"segment": "masks", "crop": "crops", "embed": "patches", "bank": "bank", "heatmap": "heatmaps", "refine": "refined"}
STATE = "project string, stage string, hash string, updated_at timestamp"


class Catalog:
    """Tables below a root folder that Spark can read and write: root/<table>/project=<name>."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # rows hold images: few of them make a batch of Python's
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))

    def path(self, table: str, project: str | None = None) -> str:
        return f"{self.root}/{table}" + (f"/project={project}" if project else "")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def exists(self, table: str, project: str | None = None) -> bool:
        fs, where = self._fs(self.path(table, project) + "/_SUCCESS")
        return fs.exists(where)

    def remove(self, table: str, project: str) -> None:
        fs, where = self._fs(self.path(table, project))
        fs.delete(where, True)

    def write(self, df: DataFrame, table: str, project: str) -> DataFrame:
        """Replace a project's part of a table.

        The new part is written aside and then moved into the old one's place. What is there is always one of
        both as a whole, or, if the driver ends between removing and moving, neither: then the stage is stale.
        """
        fs, target = self._fs(self.path(table, project))
        aside = f"{self.root}/_new/{uuid.uuid4().hex}"
        df.drop("project").write.parquet(aside)
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(self._fs(aside)[1], target):
            raise OSError(f"can't move {aside} to {target}")
        return self.read(table, project)

    def read(self, table: str, project: str, schema: str | None = None) -> DataFrame:
        """A project's part, or an empty table of the given schema."""
        if not self.exists(table, project) and schema:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.path(table, project)).withColumn("project", F.lit(project))

    def registry(self, project: str) -> DataFrame:
        """The instances as the last processing left them; empty before."""
        return self.read("registry", project, schemas.REGISTRY)

    def save_run_instances(self, run_id: str, instances: DataFrame) -> None:
        """Keep the instances of a run."""
        instances.write.mode("overwrite").parquet(f"{self.path('run_instances')}/run={run_id}")

    def run_instances(self, run_id: str) -> DataFrame:
        path = f"{self.path('run_instances')}/run={run_id}"
        fs, where = self._fs(path)
        if not fs.exists(where):
            raise FileNotFoundError(f"no instances of run {run_id!r}")
        return self.spark.read.parquet(path)

    # ---- configurations, as JSON in tables

    def save_run_config(self, run_id: str, project: str, config: dict[str, Any]) -> None:
        """Keep the configuration a run was made with."""
        self._configs([(run_id, project, json.dumps(config))]).write.mode("append").parquet(self.path("run_configs"))

    def run_config(self, run_id: str) -> dict[str, Any] | None:
        fs, where = self._fs(self.path("run_configs"))
        rows = self.spark.read.parquet(self.path("run_configs")).where(F.col("run_id") == run_id).collect() if fs.exists(where) else []
        return json.loads(rows[0]["config"]) if rows else None

    def project_config(self, project: str, default: dict[str, Any] = cfg.DEFAULTS) -> dict[str, Any]:
        """A project's configuration; where it has none it gets the default one."""
        if not self.exists("configs", project):
            self.write(self._configs([("", project, json.dumps(default))]), "configs", project)
        return json.loads(self.read("configs", project).first()["config"])

    def save_project_config(self, project: str, config: dict[str, Any]) -> None:
        self.write(self._configs([("", project, json.dumps(config))]), "configs", project)

    def _configs(self, rows: list[tuple[str, str, str]]) -> DataFrame:
        return self.spark.createDataFrame(rows, "run_id string, project string, config string")

    # ---- stage state

    def state(self, project: str) -> dict[str, str]:
        """Stage to stored hash (six rows at most)."""
        return {r["stage"]: r["hash"] for r in self.read("state", project, STATE).collect()}

    def save_state(self, project: str, stage: str, value: str | None) -> None:
        known = self.state(project) | {stage: value}
        rows = [(project, s, h, datetime.now()) for s, h in known.items() if h is not None]
        self.write(self.spark.createDataFrame(rows, STATE), "state", project)

    def invalid_stages(self, project: str, config: dict[str, Any], compat: bool = False) -> list[str]:
        """The first stage whose hash differs or whose table is missing, and all after it."""
        stored = self.state(project)
        for i, stage in enumerate(cfg.STAGES):
            if stored.get(stage) != cfg.stage_hash(config, stage, compat) or not self.exists(ARTIFACTS[stage], project):
                return cfg.STAGES[i:]
        return []

    def invalidate(self, project: str, stage: str) -> None:
        self.remove(ARTIFACTS[stage], project)
        if stage == "heatmap":
            self.remove(ARTIFACTS["refine"], project)
        self.save_state(project, stage, None)

    # ---- run log

    def append_run(self, row: dict[str, Any], defects: dict[str, float]) -> None:
        self.spark.createDataFrame([row], schemas.RUNS).write.mode("append").parquet(self.path("runs"))
        if defects:
            rows = [(row["run_id"], row["project"], d, a) for d, a in defects.items()]
            self.spark.createDataFrame(rows, schemas.RUN_DEFECTS).write.mode("append").parquet(self.path("run_defects"))

    def runs(self, project: str | None = None) -> DataFrame:
        """The run log; of one project with a column for each of its defects."""
        fs, where = self._fs(self.path("runs"))
        runs = self.spark.read.parquet(self.path("runs")) if fs.exists(where) else self.spark.createDataFrame([], schemas.RUNS)
        if project is None:
            return runs
        runs = runs.where(F.col("project") == project)
        fs, where = self._fs(self.path("run_defects"))
        if not fs.exists(where):
            return runs
        wide = self.spark.read.parquet(self.path("run_defects")).where(F.col("project") == project)
        wide = wide.withColumn("c", F.concat(F.lit("auroc_"), F.translate("defect", ", ", "__"))).groupBy("run_id").pivot("c").agg(F.first("auroc"))
        return runs.join(wide, "run_id", "left")
