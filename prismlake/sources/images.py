"""Image trees, manifests and archives as DataFrames."""

from __future__ import annotations

import os
import shutil
import tarfile
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import ids

# Categories of the public datasets.
MVTEC_AD = "bottle cable capsule carpet grid hazelnut leather metal_nut pill screw tile toothbrush transistor wood zipper".split()
MVTEC_LOCO = "breakfast_box juice_bottle pushpins screw_bag splicing_connectors".split()
MVTEC_AD2 = "can fabric fruit_jelly rice sheet_metal vial wallplugs walnuts".split()
VISA = "candle capsules cashew chewinggum fryum macaroni1 macaroni2 pcb1 pcb2 pcb3 pcb4 pipe_fryum".split()
SOURCES = {"visa": VISA, "mvtec_ad": MVTEC_AD, "mvtec_loco": MVTEC_LOCO, "mvtec_ad2": MVTEC_AD2}


def check_category(source: str, category: str) -> None:
    known = SOURCES.get(source.lower())
    if known is None:
        raise ValueError(f"unknown source {source!r}; one of {', '.join(sorted([*SOURCES, 'local']))}")
    if category not in known:
        raise ValueError(f"unknown category {category!r}; one of {', '.join(sorted(known))}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _place(path: Column) -> list[Column]:
    """split, label, stem and ext of .../{split}/{label}/{stem}.{ext}."""
    split, label = (F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]+$", i) for i in (1, 2))
    return [split.alias("split"), label.alias("label"), ids.file_stem(path).alias("stem"), ids.extension(path).alias("ext")]


def _folders(spark: SparkSession, root: str, splits: tuple[str, ...]) -> str | None:
    """A pattern of the splits' label folders, None if there are none."""
    pattern = f"{root}/{{{','.join(splits)}}}/*"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return pattern if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) else None


def image_list(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """path, split, label, stem, ext of the images below root, without reading them."""
    folders = _folders(spark, root, splits)
    if folders is None:
        return spark.createDataFrame([], "path string, split string, label string, stem string, ext string")
    files = spark.read.format("binaryFile").load(folders).select("path")
    return files.select("path", *_place(F.col("path"))).where(F.col("split").isin(*splits) & F.col("ext").isin(ids.IMAGE_EXTENSIONS))


#: Files that share their stem with another one and are read by themselves; with more all images are shuffled.
NAMES = 10_000
_IMAGES = "split string, label string, stem string, ext string, height int, width int, channels int, data binary"


def image_tree(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """root/{split}/{label}/{stem}.{ext}: split, label, stem, ext, height, width, channels, data (BGR).

    Files that can't be decoded are left out. Where a stem has two extensions the smaller one that can be decoded
    counts. Which stems have several is settled on names, so only those files are compared after decoding.
    """
    folders = _folders(spark, root, splits)
    if folders is None:
        return spark.createDataFrame([], _IMAGES)
    key = ["split", "label", "stem"]
    data = [F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")]

    def read(paths: str | list[str]) -> DataFrame:
        rows = spark.read.format("image").option("dropInvalid", True).load(paths).select(*_place(F.col("image.origin")), *data)
        return rows.where(F.col("split").isin(*splits) & F.col("ext").isin(ids.IMAGE_EXTENSIONS))

    def one_each(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.min_by(F.struct("ext", "height", "width", "channels", "data"), "ext").alias("i")).select(*key, "i.*")

    names = image_list(spark, root, splits)
    twice = names.join(names.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), key).select(*key, "path").limit(NAMES + 1).collect()
    if not twice:
        return read(folders)
    if len(twice) > NAMES:
        return one_each(read(folders))
    known = spark.createDataFrame([r[:3] for r in twice], "split string, label string, stem string").distinct()
    return read(folders).join(F.broadcast(known), key, "left_anti").unionByName(one_each(read([r["path"] for r in twice])))


def split_manifest(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """object, split, label, image, mask of a split CSV; the last row of an image wins."""
    rows = spark.read.csv(path, header=True, schema="object string, split string, label string, image string, mask string")
    if category:
        rows = rows.where(F.col("object") == category)
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    return rows.groupBy("image").agg(F.max_by(F.struct("object", "split", "label", "mask"), "_n").alias("r")).select("image", "r.*")


def annotation_manifest(spark: SparkSession, path: str) -> DataFrame:
    """image, label of an annotation CSV; empty where there is no file."""
    schema = "image string, label string"
    return spark.read.csv(path, header=True, schema=schema) if exists(spark, path) else spark.createDataFrame([], schema)


def categories(spark: SparkSession, root: str) -> list[str]:
    path = f"{root}/split_csv/1cls.csv"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return [r[0] for r in split_manifest(spark, path).select("object").distinct().orderBy("object").collect()]


def fetch(url: str, target: str, chunk: int = 1 << 20) -> str:
    """Download a file unless it is there."""
    if not os.path.exists(target):
        request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
        with urllib.request.urlopen(request) as source, open(target + ".part", "wb") as out:
            shutil.copyfileobj(source, out, chunk)
        os.replace(target + ".part", target)
    return target


def unpack(archive: str, target: str) -> str:
    """Extract a tar archive of any compression, data files only."""
    with tarfile.open(archive) as t:
        t.extractall(target, filter="data")
    return target


def npy_files(spark: SparkSession, root: str) -> DataFrame:
    """path, shape and values of .npy files."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            arrays = [np.load(io.BytesIO(b), allow_pickle=False) for b in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "shape": pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32())), "data": pa.array([a.astype(float).ravel().tolist() for a in arrays], pa.list_(pa.float64()))})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root)
    return files.select("path", "content").mapInArrow(run, "path string, shape array<int>, data array<double>")
