"""Scene descriptions: reconstruction text files, transform and dataset JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(texts: DataFrame) -> DataFrame:
    """Lines ``(path, value)`` that are neither empty nor comments."""
    return texts.where((F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("#"))


def _texts(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), "value")


def points_of_text(lines: DataFrame) -> DataFrame:
    """``(path, id, xyz, rgb, error)`` of reconstructed points in lines ``(path, value)``."""
    p = F.split(F.trim("value"), "\\s+")
    return _lines(lines).select(
        "path", F.get(p, 0).cast("long").alias("id"), F.slice(p, 2, 3).cast("array<double>").alias("xyz"), F.slice(p, 5, 3).cast("array<int>").alias("rgb"), F.get(p, 7).cast("double").alias("error")
    )


def cameras_of_text(lines: DataFrame) -> DataFrame:
    """``(path, id, model, width, height, params)`` of pinhole cameras in lines ``(path, value)``; other models raise."""
    p = F.split(F.trim("value"), "\\s+")
    model = F.get(p, 1)
    checked = F.when(model == "PINHOLE", model).otherwise(F.raise_error(F.concat(F.lit("camera model is not read: "), model)))
    return _lines(lines).select(
        "path", F.get(p, 0).cast("int").alias("id"), checked.alias("model"), F.get(p, 2).cast("long").alias("width"), F.get(p, 3).cast("long").alias("height"),
        F.slice(p, 5, F.size(p) - 4).cast("array<double>").alias("params"),
    )


def images_of_text(texts: DataFrame) -> DataFrame:
    """``(path, id, qvec, tvec, camera_id, name, xys, point_ids)`` of posed images in whole texts ``(path, value)`` with two lines an image.

    The whole file is one row, since a record's second line has no key.
    """
    kept = F.filter(F.split("value", "\n"), lambda x: ~F.trim(x).startswith("#"))
    one = lambda i: F.struct(F.get("l", 2 * i).alias("a"), F.coalesce(F.get("l", 2 * i + 1), F.lit("")).alias("b"))
    pairs = texts.select("path", kept.alias("l")).select("path", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("l") / 2).cast("int") - 1), one)).alias("r"))
    p, q = F.split(F.trim("r.a"), "\\s+"), F.filter(F.split(F.trim("r.b"), "\\s+"), lambda x: x != "")
    third = lambda k: F.filter(q, lambda _, i: i % 3 == k)
    return pairs.where(F.length(F.trim("r.a")) > 0).select(
        "path", F.get(p, 0).cast("int").alias("id"), F.slice(p, 2, 4).cast("array<double>").alias("qvec"), F.slice(p, 6, 3).cast("array<double>").alias("tvec"),
        F.get(p, 8).cast("int").alias("camera_id"), F.get(p, 9).alias("name"),
        F.arrays_zip(third(0).cast("array<double>").alias("x"), third(1).cast("array<double>").alias("y")).alias("xys"), third(2).cast("array<bigint>").alias("point_ids"),
    )


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    """``(id, xyz, rgb, error)`` of a text file of reconstructed points."""
    return points_of_text(_texts(spark, path)).drop("path")


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    """``(id, model, width, height, params)`` of a text file of pinhole cameras; other models raise."""
    return cameras_of_text(_texts(spark, path)).drop("path")


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """``(id, qvec, tvec, camera_id, name, xys, point_ids)`` of a text file with two lines an image."""
    return images_of_text(_texts(spark, path, whole=True)).drop("path")


def read_transforms(spark: SparkSession, path: str, end_frame: int | None = None) -> DataFrame:
    """One row a frame of transform JSON: file_path, time, transform_matrix, fl_x, fl_y, w, h."""
    frames = "array<struct<file_path:string,time:double,transform_matrix:array<array<double>>,fl_x:double,fl_y:double,w:int,h:int>>"
    df = spark.read.json(path, schema=f"frames {frames}, fl_x double, fl_y double, w int, h int", multiLine=True)
    f = df.select(F.posexplode("frames").alias("at", "f"), *(F.col(c).alias(f"_{c}") for c in ("fl_x", "fl_y", "w", "h")))
    f = f.where(F.col("at") < end_frame) if end_frame is not None else f
    return f.select("at", "f.file_path", "f.time", "f.transform_matrix", *(F.coalesce(F.col(f"f.{c}"), F.col(f"_{c}")).alias(c) for c in ("fl_x", "fl_y", "w", "h")))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``(at, id, part)`` of dataset JSON: the position of each image id, and train or val."""
    df = spark.read.json(path, schema="ids array<string>, train_ids array<string>, val_ids array<string>", multiLine=True)
    ids = df.select(F.posexplode("ids").alias("at", "id"), "train_ids", "val_ids")
    part = F.when(F.array_contains("val_ids", F.col("id")), "val").when(F.array_contains("train_ids", F.col("id")), "train")
    return ids.select("at", "id", part.alias("part"))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """``(path, frame, h, w, data)`` of mask images: a pixel is set where the mean of its
    colour channels is above 127, bit-packed; frame is the last run of digits of the name."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())])

    def decode(batches):
        for batch in batches:
            rows = []
            for image in batch.column("image").to_pylist():
                shape = image["height"], image["width"], image["nChannels"]
                pixels = np.frombuffer(image["data"], np.uint8).reshape(shape)[..., :3].astype(np.float32)
                rows.append({"path": image["origin"], "h": shape[0], "w": shape[1], "data": np.packbits(pixels.mean(axis=2) > 127).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    images = spark.read.format("image").option("dropInvalid", True).load(path)
    masks = images.mapInArrow(decode, "path string, h int, w int, data binary")
    stem = F.regexp_extract("path", "([^/]*)\\.[^./]*$", 1)
    digits = F.try_element_at(F.regexp_extract_all(stem, F.lit("(\\d+)"), F.lit(1)), F.lit(-1))
    return masks.select("path", digits.cast("int").alias("frame"), "h", "w", "data")
