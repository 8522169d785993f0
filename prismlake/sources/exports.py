"""Files for other tools: PNG and .npy rows, CSV of registry and runs, bank lists, crop metadata."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import raster


def _files(rows: DataFrame, path: F.Column, content) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"path": batch.column("_path"), "content": pa.array([content(r) for r in batch.to_pylist()], pa.binary())})

    return rows.withColumn("_path", path).mapInArrow(run, "path string, content binary")


def mask_files(instances: DataFrame) -> DataFrame:
    """masks/{split}/{label}/{instance_id}.png with 0 and 255."""
    path = F.concat_ws("/", F.lit("masks"), "split", "label", F.concat("instance_id", F.lit(".png")))
    return _files(instances.select("split", "label", "instance_id", "h", "w", "mask"), path, lambda r: raster.png(np.frombuffer(r["mask"], np.uint8).reshape(r["h"], r["w"]) * 255))


def heatmap_files(maps: DataFrame, kind: str = "refined") -> DataFrame:
    """heatmaps/{kind}/{split}/{label}/{stem}.npy in single precision."""

    def npy(row: dict) -> bytes:
        out = io.BytesIO()
        np.save(out, np.array(row["data"], np.float32).reshape(row["h"], row["w"]), allow_pickle=False)
        return out.getvalue()

    path = F.concat_ws("/", F.lit("heatmaps"), F.lit(kind), "split", "label", F.concat("stem", F.lit(".npy")))
    return _files(maps.select("split", "label", "stem", "h", "w", "data"), path, npy)


def box_files(crops: DataFrame) -> DataFrame:
    """crops/boxes/{split}/{label}/{instance_id}.png: each crop's frame, axis and centre on a blank canvas."""
    path = F.concat_ws("/", F.lit("crops"), F.lit("boxes"), "split", "label", F.concat("instance_id", F.lit(".png")))
    rows = crops.select("split", "label", "instance_id", "crop_transform", "crop_size", "original_size")
    return _files(rows, path, lambda r: raster.png(raster.crop_box(np.array(r["crop_transform"]), tuple(r["crop_size"]), tuple(r["original_size"]))))


def overlay_files(images: DataFrame, maps: DataFrame) -> DataFrame:
    """overlays/{split}/{label}/{stem}.png: heatmaps in colour over their images."""
    path = F.concat_ws("/", F.lit("overlays"), "split", "label", F.concat("stem", F.lit(".png")))
    source = images.select("split", "label", "stem", "height", "width", "channels", F.col("data").alias("pixels"))
    rows = maps.select("split", "label", "stem", "h", "w", "data").join(source, ["split", "label", "stem"])

    def drawn(r: dict) -> bytes:
        image = raster.from_spark(r["height"], r["width"], r["channels"], r["pixels"])
        return raster.png(raster.overlay(image, np.array(r["data"], float).reshape(r["h"], r["w"])))

    return _files(rows, path, drawn)


def write_files(files: DataFrame, root: str) -> None:
    """Each file below a folder that all workers share (a path, or an address of a store), written aside and moved."""

    def write(rows) -> None:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for r in rows:
            target = f"{base}/{r['path']}"
            store.create_dir(target.rpartition("/")[0], recursive=True)
            with store.open_output_stream(target + ".part") as f:
                f.write(r["content"])
            store.move(target + ".part", target)

    files.foreachPartition(write)


def as_csv(rows: DataFrame) -> DataFrame:
    """Columns that CSV can hold: arrays as JSON, nulls as empty strings."""
    return rows.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes))


def write_csv(rows: DataFrame, path: str) -> None:
    as_csv(rows).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def bank_list(bank: DataFrame) -> DataFrame:
    """One line for each chosen instance, in the order of choice."""
    return bank.select("rank", "instance_id").distinct().orderBy("rank").select(F.col("instance_id").alias("value"))
