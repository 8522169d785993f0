"""The six stages from images to refined heatmaps, each from tables to a table.

Relational work is DataFrame code; models and raster kernels run on Arrow batches. A segmenter maps images to
masks, an embedder a crop to a grid of patch vectors; the defaults need no model files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake import config as cfg
from prismlake.functions import ids, raster, vec
from prismlake.operators import heatmap as heat
from prismlake.operators import select


class SegmentationError(RuntimeError):
    """Images without a mask."""


class Segmenter(Protocol):
    """One image's masks; a model that takes several images at once also has many(images, prompt)."""

    def __call__(self, image: np.ndarray, prompt: str) -> list[np.ndarray]: ...


class Embedder(Protocol):
    """One image's grid of vectors; a model that takes several images at once also has many(images, grid)."""

    def __call__(self, image: np.ndarray, grid: tuple[int, int]) -> np.ndarray: ...


def answers(model: Callable, images: list[np.ndarray], *more: Any) -> list:
    """A model's answers for some images, in one call where it takes several."""
    many = getattr(model, "many", None)
    return list(many(images, *more)) if many else [model(image, *more) for image in images]


def threshold_segmenter(image: np.ndarray, prompt: str) -> list[np.ndarray]:
    """Stand-in for a model: what is brighter than the mean of the darkest and brightest pixel."""
    g = raster.gray(image).astype(float)
    if g.max() - g.min() < 1:
        return []
    return [g > (g.max() + g.min()) / 2]


def patch_statistics(image: np.ndarray, grid: tuple[int, int]) -> np.ndarray:
    """Stand-in for a model: per patch the mean and deviation of each channel and mean differences along both axes."""
    rgb = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image
    h, w = rgb.shape[0] // grid[0], rgb.shape[1] // grid[1]
    a = rgb[: h * grid[0], : w * grid[1]].astype(float).reshape(grid[0], h, grid[1], w, 3) / 255
    g = a.mean(axis=4)
    return np.concatenate([a.mean(axis=(1, 3)), a.std(axis=(1, 3)), np.abs(np.diff(g, axis=1)).mean(axis=(1, 3))[..., None], np.abs(np.diff(g, axis=3)).mean(axis=(1, 3))[..., None], np.full((*grid, 1), 0.1)], axis=2)


def extract_masks(result: Any) -> list[np.ndarray]:
    """A model's answer (nothing, one mask, or a stack or list of masks) as a list of masks."""
    if result is None:
        return []
    if isinstance(result, (list, tuple)):
        return [m for r in result for m in extract_masks(r)]
    a = np.asarray(result)
    return [a > 0] if a.ndim == 2 else [m > 0 for m in a.reshape(-1, *a.shape[-2:])]


@dataclass
class Context:
    config: dict[str, Any]
    segmenter: Callable = threshold_segmenter
    embedder: Callable = patch_statistics
    #: Images in a call of the models.
    segment_batch: int = 8
    embed_batch: int = 16

    @property
    def grid(self) -> tuple[int, int]:
        return tuple(cfg.value(self.config, "transformer.map_resolution"))

    @property
    def out_size(self) -> tuple[int, int]:
        """Width and height of crops."""
        patch = cfg.value(self.config, "transformer.patch_size")
        return self.grid[1] * patch, self.grid[0] * patch


def _image(row: dict) -> np.ndarray:
    return raster.from_spark(row["height"], row["width"], row["channels"], row["data"])


def _batched(fn: Callable[[list[dict]], Iterator[dict]], schema: str, size: int = 1) -> Callable:
    """A function of at most `size` rows for mapInArrow; arrays of numbers may come as numpy arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                found = list(fn(batch.slice(i, size).to_pylist()))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=target)

    return run


def _rows(fn: Callable[[dict], Iterator[dict]], schema: str) -> Callable:
    return _batched(lambda rows: fn(rows[0]), schema)


MASKS = "split string, label string, stem string, prompt string, prompt_pos int, mask_pos int, h int, w int, mask binary"


def segment(ctx: Context, images: DataFrame) -> DataFrame:
    """Instances with masks: split, label, stem, instance_id, image, segment_prompt, mask_area_px, h, w, mask.

    Raises SegmentationError for images without a mask. Disabled: one empty mask for each image.
    """
    seg = ctx.config["segmentation"]
    if not seg.get("enabled", True):
        blank = images.select("split", "label", "stem", F.lit(None).cast("string").alias("prompt"), F.lit(0).alias("idx"), F.col("height").alias("h"), F.col("width").alias("w"))
        blank = blank.withColumn("mask", F.to_binary(F.repeat(F.lit("00"), F.col("h") * F.col("w")), F.lit("hex")))
        return _instances(blank)
    prompts, several, segmenter = seg["prompts"], seg.get("multi_instance", True), ctx.segmenter

    def masks(rows: list[dict]) -> Iterator[dict]:
        pictures = [_image(row) for row in rows]
        for k, prompt in enumerate(prompts):
            for row, result in zip(rows, answers(segmenter, pictures, prompt)):
                found = extract_masks(result)
                if not several and len(found) > 1:
                    found = [np.logical_or.reduce(found)]
                for i, m in enumerate(found):
                    yield {"split": row["split"], "label": row["label"], "stem": row["stem"], "prompt": prompt, "prompt_pos": k, "mask_pos": i, "h": m.shape[0], "w": m.shape[1], "mask": m.astype(np.uint8).tobytes()}

    found = images.mapInArrow(_batched(masks, MASKS, ctx.segment_batch), MASKS)
    order = Window.partitionBy("split", "label", "stem").orderBy("prompt_pos", "mask_pos")
    return _instances(found.withColumn("idx", F.row_number().over(order) - 1))


def _instances(masks: DataFrame) -> DataFrame:
    return masks.select(
        "split", "label", "stem", ids.instance_id("stem", "idx").alias("instance_id"), ids.image_id("split", "label", "stem").alias("image"),
        F.col("prompt").alias("segment_prompt"), ((F.length(F.hex("mask")) - F.length(F.replace(F.hex("mask"), F.lit("01"), F.lit("")))) / 2).cast("long").alias("mask_area_px"),
        "h", "w", "mask",
    )


def require_masks(images: DataFrame, masks: DataFrame) -> None:
    """Raise with the first ten of the images that have no mask."""
    keys = ["split", "label", "stem"]
    missing = images.select(*keys).join(masks.select(*keys), keys, "left_anti")
    first = missing.orderBy(*keys).limit(11).collect()
    if first:
        more = missing.count() - 10
        raise SegmentationError("no mask for: " + ", ".join("/".join(r) for r in first[:10]) + (f" ... {more} more" if more > 0 else ""))


CROPS = "split string, label string, stem string, instance_id string, crop_iou double, crop_size array<int>, alignment_angle double, crop_transform array<double>, original_size array<int>, crop binary, crop_mask binary, channels int"


def reference_mask(ctx: Context, instances: DataFrame) -> np.ndarray | None:
    """The mask others are turned to: the named instance's or the first large training one's; only if turns are tried."""
    crop = ctx.config["crop"]
    if not crop["align_PCA"] or len(crop["angle_candidates"]) <= 1:
        return None
    good = instances.where("split = 'train' AND label = 'good' AND mask_area_px > 100")
    if crop.get("reference_id"):
        good = instances.where(F.col("instance_id") == crop["reference_id"])
    row = good.orderBy("split", "label", "instance_id").select("h", "w", "mask").first()
    if row is None:
        return None
    mask = np.frombuffer(row["mask"], np.uint8).reshape(row["h"], row["w"])
    if mask.sum() < 10:
        return None
    return raster.aligned_crop(None, mask, ctx.out_size, scale=crop["scale"], offset=crop["offset_rotation"])["mask"]


def crop(ctx: Context, images: DataFrame, instances: DataFrame) -> DataFrame:
    conf, out, reference = ctx.config["crop"], ctx.out_size, reference_mask(ctx, instances)

    def cut(row: dict) -> Iterator[dict]:
        image, mask = _image(row), np.frombuffer(row["mask"], np.uint8).reshape(row["h"], row["w"])
        got = raster.aligned_crop(image, mask, out, scale=conf["scale"], offset=conf["offset_rotation"], align=conf["align_PCA"], candidates=conf["angle_candidates"], reference=reference)
        yield {k: row[k] for k in ("split", "label", "stem", "instance_id")} | {
            "crop_iou": got["iou"], "crop_size": list(out), "alignment_angle": got["angle"], "crop_transform": got["matrix"].ravel().tolist(),
            "original_size": [row["width"], row["height"]], "crop": got["image"].tobytes(), "crop_mask": got["mask"].tobytes(), "channels": 1 if image.ndim == 2 else 3,
        }

    rows = instances.join(images, ["split", "label", "stem"]).select("split", "label", "stem", "instance_id", "h", "w", "mask", "height", "width", "channels", "data")
    return rows.mapInArrow(_rows(cut, CROPS), CROPS)


def crop_metadata(crops: DataFrame) -> DataFrame:
    """Per source image its size and its instances with their transforms, in order."""
    one = F.struct("instance_id", F.col("crop_transform").alias("transform"), "crop_size")
    grouped = crops.groupBy("split", "label", "stem").agg(F.first("original_size").alias("original_size"), F.array_sort(F.collect_list(one)).alias("instances"))
    return grouped.withColumn("image", ids.image_id("split", "label", "stem"))


EMBEDDED = "split string, label string, stem string, instance_id string, p int, v array<float>"


def embed(ctx: Context, crops: DataFrame) -> DataFrame:
    """Unit patch vectors in single precision by place (row-major)."""
    grid, embedder = ctx.grid, ctx.embedder

    def image(row: dict) -> np.ndarray:
        w, h = row["crop_size"]
        a = np.frombuffer(row["crop"], np.uint8)
        return a.reshape(h, w) if row["channels"] == 1 else a.reshape(h, w, 3)

    def vectors(rows: list[dict]) -> Iterator[dict]:
        for row, found in zip(rows, answers(embedder, [image(r) for r in rows], grid)):
            v = np.asarray(found, float).reshape(grid[0] * grid[1], -1)
            v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), vec.EPS)).astype(np.float32)
            for p in range(len(v)):
                yield {k: row[k] for k in ("split", "label", "stem", "instance_id")} | {"p": p, "v": v[p]}

    return crops.mapInArrow(_batched(vectors, EMBEDDED, ctx.embed_batch), EMBEDDED)


def bank(ctx: Context, patches: DataFrame) -> DataFrame:
    """Patches of the chosen training instances, with their rank."""
    good = patches.where("split = 'train' AND label = 'good'")
    pooled = vec.mean_pool(good, ["instance_id"])
    first = pooled.select(F.size("v").alias("c")).first()
    if first is None:
        raise ValueError("no good training instances")
    n, conf = pooled.count(), ctx.config["memory_bank"]
    k = pooled.sparkSession.range(1).select(select.capacity(conf["max_gb"], *ctx.grid, first["c"], n)).first()[0]
    if conf["selection_method"] == "random":
        chosen = select.random_k(pooled, "instance_id", k).withColumn("rank", F.row_number().over(Window.orderBy("instance_id"))).select("rank", "instance_id")
    else:
        chosen = select.k_center(pooled.withColumn("project", F.lit("")), "project", "instance_id", "v", k).select("rank", "instance_id")
    return good.join(chosen, "instance_id").select("rank", "instance_id", "p", "v")


def heatmaps(ctx: Context, patches: DataFrame, bank_: DataFrame, crops: DataFrame) -> DataFrame:
    """Per image the reverted heatmap in original size: split, label, stem, h, w, data."""
    grid, out = ctx.grid, ctx.out_size
    keyed = patches.withColumn("key", F.concat_ws("/", "split", "label", "instance_id"))
    scored = heat.min_cosine_kernel(keyed.select("key", "p", "v"), bank_.select("p", "v"), "key")
    packed = scored.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "d"))).alias("cells"))
    rows = crops.withColumn("key", F.concat_ws("/", "split", "label", "instance_id")).select("key", "split", "label", "stem", "crop_transform", "original_size", "crop_size").join(packed, "key")
    schema = "split string, label string, stem string, w int, h int, data array<float>"

    def revert(row: dict) -> Iterator[dict]:
        a = np.array([c["d"] for c in row["cells"]]).reshape(grid)
        size = tuple(row["original_size"])
        # the crop's transform leads from a place in the original to one in the crop
        back = raster.warp(raster.resize(a, out), row["crop_transform"], size, inverse=True)
        yield {"split": row["split"], "label": row["label"], "stem": row["stem"], "w": size[0], "h": size[1], "data": back.astype(np.float32).ravel()}

    maps = rows.mapInArrow(_rows(revert, schema), schema)

    def compose(row: dict) -> Iterator[dict]:
        whole = np.maximum(0, np.max([np.array(d, np.float32) for d in row["parts"]], axis=0))
        yield {k: row[k] for k in ("split", "label", "stem", "w", "h")} | {"data": whole}

    # an image's instances are few; together they are one row
    parts = maps.groupBy("split", "label", "stem", "w", "h").agg(F.collect_list("data").alias("parts"))
    return parts.mapInArrow(_rows(compose, schema), schema)


def refine(ctx: Context, maps: DataFrame, images: DataFrame) -> DataFrame:
    """Refined heatmaps; the plain ones for method raw."""
    conf = ctx.config["refine"]
    method = conf["method"]
    fn = raster.refiner(conf, method)
    if fn is None:
        return maps
    schema = "split string, label string, stem string, w int, h int, data array<float>"

    source = images.select("split", "label", "stem", "height", "width", "channels", F.col("data").alias("pixels"))
    rows = maps.join(source, ["split", "label", "stem"], "left") if method.startswith("guided") else maps.withColumn("pixels", F.lit(None).cast("binary"))

    def one(row: dict) -> Iterator[dict]:
        image = None if row["pixels"] is None else raster.from_spark(row["height"], row["width"], row["channels"], row["pixels"])
        a = fn(np.array(row["data"], float).reshape(row["h"], row["w"]), image)
        yield {k: row[k] for k in ("split", "label", "stem", "w", "h")} | {"data": np.asarray(a, np.float32).ravel()}

    return rows.mapInArrow(_rows(one, schema), schema)
