"""Names, paths and ids of images and instances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted image extensions.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "bmp"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instance_id(stem: Column | str, index: Column | str) -> Column:
    return F.format_string("%s_%02d", col(stem), col(index))


def image_id(split: Column | str, label: Column | str, stem: Column | str) -> Column:
    return F.concat_ws("/", col(split), col(label), col(stem))


def stem_of(instance: Column | str) -> Column:
    """The image's stem of an instance id; ids without a two-digit index stay as they are (so `x_100` does)."""
    return F.regexp_replace(col(instance), r"^(.*)_\d{2}$", "$1")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def is_image(path: Column | str) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def file_stem(path: Column | str) -> Column:
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def routed(split: Column | str, label: Column | str, defect: Column | str) -> tuple[Column, Column]:
    """Split and label of a manifest row: normal training images, normal others, all anomalous ones to test."""
    normal = col(label) == "normal"
    return (
        F.when(normal & (col(split) == "train"), "train").otherwise("test"),
        F.when(normal, "good").otherwise(F.coalesce(col(defect), F.lit("anomaly"))),
    )
