"""Projects: prepare data, run the stale stages, score, log."""

from __future__ import annotations

import time
import uuid
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake import config as cfg
from prismlake.catalog import ARTIFACTS, Catalog
from prismlake.functions import ids, metrics
from prismlake.operators import select
from prismlake.sources import images as sources
from prismlake.sources import urls

from . import stages
from .stages import Context


# ---- prepare


def prepare_project(catalog: Catalog, source: str, category: str, root: str, *, name: str | None = None, download: bool = False) -> str:
    """Read a dataset's folder into the project's image and ground-truth tables; returns the project's name.

    source: visa (with split CSVs), mvtec_ad, mvtec_loco, mvtec_ad2 or local (folders by split and label).
    download: root is a folder of datasets, to which the category's archive is fetched and unpacked unless it is there.
    The project gets the default configuration unless it has one.
    """
    source, project = source.lower(), name or category
    spark = catalog.spark
    if source != "local":
        sources.check_category(source, category)
        if download:
            root = urls.download(source, category, f"{root}/{source}")
    if source == "visa":
        known = sources.categories(spark, root)
        if category not in known:
            raise ValueError(f"unknown category {category!r}; one of {', '.join(known)}")
        rows, truth = _visa(spark, root, category)
    else:
        labels = {(r["split"], r["label"]) for r in sources.image_list(spark, root).select("split", "label").distinct().collect()}  # folder names
        if ("train", "good") not in labels or not any(s == "test" for s, _ in labels):
            raise FileNotFoundError(f"{root}: needs train/good and test")
        rows = sources.image_tree(spark, root)
        truth = sources.image_tree(spark, root, ("ground_truth",))
        own = F.regexp_replace("stem", "_mask$", "")
        names = sources.image_list(spark, root, ("ground_truth",)).groupBy("label", own.alias("own")).agg(F.count_distinct("stem").alias("n"))
        if not names.where("n > 1").isEmpty():  # the shorter name counts
            truth = truth.groupBy("label", own.alias("own")).agg(F.min_by(F.struct("stem", "height", "width", "channels", "data"), "stem").alias("t")).select("label", "t.*")
        truth = truth.select("label", own.alias("stem"), "height", "width", "channels", "data")
    catalog.write(rows, "images", project)
    catalog.write(truth, "ground_truth", project)
    catalog.project_config(project)
    return project


def _visa(spark: SparkSession, root: str, category: str) -> tuple[DataFrame, DataFrame]:
    manifest = sources.split_manifest(spark, f"{root}/split_csv/1cls.csv", category)
    notes = sources.annotation_manifest(spark, f"{root}/{category}/image_anno.csv").withColumnRenamed("label", "defect")
    split, label = ids.routed("split", "label", "defect")
    plan = manifest.join(notes, "image", "left").select("image", "mask", split.alias("split"), label.alias("label"))
    files = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(f"{root}/{category}/Data")
    at = F.regexp_extract("image.origin", rf"({category}/Data/.*)$", 1)
    files = files.select(at.alias("file"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    rows = plan.join(files, plan["image"] == files["file"]).select("split", "label", ids.file_stem("image").alias("stem"), ids.extension("image").alias("ext"), "height", "width", "channels", "data")
    masks = plan.where("label <> 'good'").join(files, plan["mask"] == files["file"]).select("label", ids.file_stem("image").alias("stem"), "height", "width", "channels", "data")
    return rows, masks.dropDuplicates(["label", "stem"])


def ingest_counts(catalog: Catalog, project: str) -> DataFrame:
    good = F.col("label") == "good"
    return catalog.read("images", project).agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if((F.col("split") == "test") & good).alias("test_normal"), F.count_if(~good).alias("test_anomaly"),
        F.array_join(F.sort_array(F.collect_set(F.when(~good, F.col("label")))), ", ").alias("defects"),
    )


# ---- process


#: The tables that a stage reads.
NEEDS = {"segment": ["images"], "crop": ["images", "masks"], "embed": ["crops"], "bank": ["patches"], "heatmap": ["patches", "bank", "crops"], "refine": ["images", "heatmaps"]}


def process_project(catalog: Catalog, project: str, config: dict[str, Any], *, force_from: str | None = None, context: Context | None = None, compat: bool = False) -> dict[str, Any]:
    """Run the stages whose parameters or tables have changed, and all after them; a second call runs none.

    At the end the registry of instances is written. Without images it is an error; with compat, where nothing is there to
    segment, stages without the table they need are left out and named in stages_skipped, and hashes and bank
    membership are the historic ones.
    """
    ctx = context or Context(config)
    if not catalog.exists("images", project) and not compat:
        raise FileNotFoundError(f"project {project!r} has no images; prepare it first")
    if force_from is not None:
        if force_from not in cfg.STAGES:
            raise ValueError(f"unknown stage {force_from!r}; one of {', '.join(cfg.STAGES)}")
        todo = cfg.STAGES[cfg.STAGES.index(force_from) :]
    else:
        todo = catalog.invalid_stages(project, config, compat)
    began, timings, skipped = time.time(), {}, []
    read = lambda stage: catalog.read(ARTIFACTS[stage], project).drop("project")
    if catalog.exists("images", project):
        for stage in todo:
            catalog.invalidate(project, stage)
        images = catalog.read("images", project).drop("project")
    for stage in todo:
        start = time.time()
        if missing := [t for t in NEEDS[stage] if not catalog.exists(t, project)]:
            if not compat:
                raise FileNotFoundError(f"stage {stage!r} of project {project!r} needs {', '.join(missing)}")
            skipped.append(stage)
            continue
        if stage == "segment":
            catalog.write(stages.segment(ctx, images), ARTIFACTS[stage], project)
            stages.require_masks(images, read("segment"))
        elif stage == "crop":
            catalog.write(stages.crop(ctx, images, read("segment")), ARTIFACTS[stage], project)
        elif stage == "embed":
            catalog.write(stages.embed(ctx, read("crop")), ARTIFACTS[stage], project)
        elif stage == "bank":
            catalog.write(stages.bank(ctx, read("embed")), ARTIFACTS[stage], project)
        elif stage == "heatmap":
            catalog.write(stages.heatmaps(ctx, read("embed"), read("bank"), read("crop")), ARTIFACTS[stage], project)
        else:
            catalog.write(stages.refine(ctx, read("heatmap"), images), ARTIFACTS[stage], project)
        catalog.save_state(project, stage, cfg.stage_hash(config, stage, compat))
        timings[stage] = time.time() - start
    if timings or (not skipped and not catalog.exists("registry", project)):
        catalog.write(registry(catalog, project, compat=compat), "registry", project)
    ran = [s for s in todo if s not in skipped]
    return {"project": project, "instances": catalog.registry(project).count(), "stages_run": ran, "stages_skipped": skipped, "timings": timings, "total_time": time.time() - began}


def registry(catalog: Catalog, project: str, *, compat: bool = False) -> DataFrame:
    """The instances with what each stage knows of them. compat: bank membership by instance_id alone."""
    key = ["split", "label", "instance_id"]
    out = catalog.read("masks", project).select("project", *key, "image", "mask_area_px", "segment_prompt")
    out = out.join(catalog.read("crops", project).select(*key, "crop_iou", "crop_size", "alignment_angle", "crop_transform"), key, "left")
    shapes = catalog.read("patches", project).groupBy(*key).agg(F.count("*").cast("int").alias("n"), F.first(F.size("v")).alias("c")).select(*key, F.array("n", "c").alias("embed_shape"))
    members = catalog.read("bank", project).select("instance_id").distinct().withColumn("hit", F.lit(True))
    if not compat:
        members = members.withColumn("split", F.lit("train")).withColumn("label", F.lit("good"))
    out = out.join(shapes, key, "left").join(members, ["instance_id"] if compat else key, "left")
    return out.withColumn("in_bank", F.coalesce("hit", F.lit(False))).drop("hit")


# ---- score


def image_scores(maps: DataFrame, method: str, low: float, high: float) -> DataFrame:
    """label, stem and band score of each test heatmap, each where its row is."""
    return maps.where("split = 'test'").select("label", "stem", metrics.band_of("data", low, high, method).alias("score"))


def pixel_rows(maps: DataFrame, truth: DataFrame, sample: int | None) -> DataFrame:
    """y and v of the pixels (a sample of each image) of test images with ground truth of the same size.

    A pixel takes its byte of the mask along, not the mask, so only pixels of the sample are shuffled.
    """
    bits = truth.select("label", "stem", "height", "width", "channels", F.col("data").alias("mask"))
    both = maps.where("split = 'test'").join(bits, ["label", "stem"]).where("h = height AND w = width")
    pixels = both.select("label", "stem", "channels", "mask", F.posexplode("data").alias("i", "v"))
    byte = F.conv(F.hex(F.substring("mask", (F.col("i") * F.col("channels") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    pixels = pixels.select("label", "stem", "i", F.col("v").cast("double").alias("v"), (byte > 127).alias("y"))
    return select.sample_per_group(pixels, ["label", "stem"], ["i"], sample).select("y", "v")


def score_project(catalog: Catalog, project: str, config: dict[str, Any], *, method: str | None = None, min_pct: float | None = None, max_pct: float | None = None, pixel_sample: int | None = 100_000, save: bool = True) -> dict[str, Any] | None:
    """Image and pixel metrics of the refined heatmaps; None where there are none. save appends to the run log."""
    conf = config["score"]
    method, low, high = method or conf["method"], conf["min_percentile"] if min_pct is None else min_pct, conf["max_percentile"] if max_pct is None else max_pct
    start = time.time()
    if not catalog.exists("refined", project):
        return None
    maps = catalog.read("refined", project)
    scores = catalog.write(image_scores(maps, method, low, high), "scores", project)
    n = scores.count()
    if not n:
        return None
    finite, bad = scores.where(metrics.is_finite("score")), F.col("label") != "good"
    found = metrics.moments(finite, "score", bad).first().asDict()
    counts = finite.agg(F.count_if(~bad).alias("n"), F.count_if(bad).alias("a")).first()
    found |= metrics.thresholds(finite, "score", bad).agg(metrics.auroc().alias("auroc_image"), metrics.average_precision().alias("ap_image")).first().asDict() if counts["n"] + counts["a"] else {}
    defects = {r["defect"]: r["auroc"] for r in metrics.per_defect(finite, "score", "label").collect()}  # a row for each defect
    pixels = pixel_rows(maps, catalog.read("ground_truth", project), pixel_sample)
    found["auroc_pixel"] = metrics.thresholds(pixels, "v", F.col("y")).agg(metrics.auroc()).first()[0]
    now = datetime.now()
    row = {
        "run_id": f"run_{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}" if save else "", "project": project, "timestamp": now.isoformat(timespec="seconds"),
        "mode": "image_heatmap", "heatmap_source": "refined", "method": method, "min_pct": float(low), "max_pct": float(high),
        "map_resolution_area": int(cfg.map_area(config["transformer"]["map_resolution"])), "pixel_sample": pixel_sample, "n_test_heatmaps": n,
        "n_normal_images": counts["n"], "n_anomaly_images": counts["a"], "score_time_s": round(time.time() - start, 2), **found,
    }
    if save:
        catalog.append_run(row, {d: a for d, a in defects.items() if a is not None})
        catalog.save_run_config(row["run_id"], project, config)
        catalog.save_run_instances(row["run_id"], catalog.registry(project))
    return row | {"per_defect": defects}


def sweep(catalog: Catalog, projects: dict[str, dict[str, Any]], *, force_from: str | None = None) -> dict[str, Any]:
    """Process and score several projects; an error of one doesn't stop the others."""
    out: dict[str, Any] = {}
    for project, config in projects.items():
        try:
            process_project(catalog, project, config, force_from=force_from)
            out[project] = score_project(catalog, project, config)
        except Exception as error:
            out[project] = error
    return out
