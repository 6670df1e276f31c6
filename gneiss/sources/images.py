"""Pixels of image files: label maps, presence masks, resampled images, stacks over prompts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IMAGE = "path string, h int, w int, channels int, data binary"
#: Shares of red, green and blue in the grey of an image, in 65536ths (fixed values of the common conversion).
GREY = (19595, 38470, 7471)


def _images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", True).load(path)


def pixels_of(image: dict) -> np.ndarray:
    """(height, width, channels) with colours as red, green, blue; Spark keeps them the other way round."""
    data = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return data if image["nChannels"] == 1 else data[..., [2, 1, 0, *range(3, image["nChannels"])]]


def _decoded(images: DataFrame, work) -> DataFrame:
    """``(path, h, w, channels, data)`` of what ``work(pixels)`` makes of every image."""

    def decode(batches):
        for batch in batches:
            for image in batch.column("image").to_pylist():
                out = work(pixels_of(image))
                row = {"path": image["origin"], "h": out.shape[0], "w": out.shape[1], "channels": out.shape[2] if out.ndim > 2 else 1, "data": out.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("h", "w", "channels")), ("data", pa.binary())]))

    return images.mapInArrow(decode, _IMAGE)


def last_number(path: str = "path"):
    """The last run of digits in a file's stem."""
    stem = F.regexp_extract(path, "([^/]*)\\.[^./]*$", 1)
    return F.try_element_at(F.regexp_extract_all(stem, F.lit("(\\d+)"), F.lit(1)), F.lit(-1)).cast("int")


def read_label_maps(spark: SparkSession, path: str) -> DataFrame:
    """``(path, frame, h, w, data)``: the first channel of every image, a byte a pixel."""
    maps = _decoded(_images(spark, path), lambda p: np.ascontiguousarray(p[..., 0]))
    return maps.select("path", last_number().alias("frame"), "h", "w", "data")


def label_pixels(maps: DataFrame) -> DataFrame:
    """``(frame, y, x, k)`` of label maps, a row for every pixel that is not 0."""

    def spell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grid = np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"])
                y, x = np.nonzero(grid)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), row["frame"]), pa.int32()), *(pa.array(c.astype(np.int32)) for c in (y, x, grid[y, x]))], ["frame", "y", "x", "k"])

    return maps.select("frame", "h", "w", "data").mapInArrow(spell, "frame int, y int, x int, k int")


def nearest(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each pixel from the one that its place times the ratio of sizes falls in."""
    h, w = pixels.shape[:2]
    return pixels[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def read_presence(spark: SparkSession, path: str, frames: DataFrame) -> DataFrame:
    """``(frame, h, w, data)`` of every row of ``frames`` (frame, h, w): its mask image, bit-packed.

    A pixel is set where its grey is above 0 (not 127).  A mask of another shape
    is resampled to the nearest pixel; a frame without an image is background.
    """
    grey = _decoded(_images(spark, path), lambda p: p[..., 0] if p.shape[2] == 1 else ((p[..., :3].astype(np.int64) @ np.array(GREY) + 0x8000) >> 16).astype(np.uint8))
    found = grey.select(last_number().alias("_of"), F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("data").alias("_data"))
    joined = frames.select("frame", "h", "w").join(found, F.col("frame") == F.col("_of"), "left")

    def fit(batches):
        for batch in batches:
            for r in batch.to_pylist():
                mask = np.zeros((r["h"], r["w"]), bool)
                if r["_data"] is not None:
                    mask = nearest(np.frombuffer(r["_data"], np.uint8).reshape(r["_h"], r["_w"]) > 0, r["h"], r["w"])
                yield pa.RecordBatch.from_pylist([{"frame": r["frame"], "h": r["h"], "w": r["w"], "data": np.packbits(mask).tobytes()}], schema=pa.schema([("frame", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())]))

    return joined.drop("_of").select(F.col("frame").cast("int").alias("frame"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "_h", "_w", "_data").mapInArrow(fit, "frame int, h int, w int, data binary")


def _weights(size: int, to: int) -> np.ndarray:
    """(to, size) shares of a cubic kernel (a = -1/2), widened by the ratio where an axis shrinks."""
    ratio = size / to
    stretch = max(ratio, 1.0)
    t = np.abs((np.arange(size) + 0.5 - (np.arange(to)[:, None] + 0.5) * ratio) / stretch)
    w = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resampled(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bytes of an image at another size, along x and then y, rounded after each."""
    if pixels.shape[:2] == (height, width):
        return pixels
    rounded = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    across = rounded(np.einsum("xw,hwc->hxc", _weights(pixels.shape[1], width), pixels.astype(float)))
    return rounded(np.einsum("yh,hxc->yxc", _weights(pixels.shape[0], height), across)).astype(np.uint8)


def target_size(width: int, height: int, resolution: float, scale: float = 1.0) -> tuple[int, int]:
    """(width, height): 1, 2, 4 and 8 divide; -1 lets widths end at 1600; others are widths."""
    if resolution in (1, 2, 4, 8):
        return round(width / (scale * resolution)), round(height / (scale * resolution))
    down = scale * (max(width / 1600, 1) if resolution == -1 else width / resolution)
    return int(width / down), int(height / down)


def read_images(spark: SparkSession, path: str, resolution: float = -1, scale: float = 1.0) -> DataFrame:
    """``(path, frame, h, w, channels, data)``: images at the size that the resolution rule gives them, colours as red, green, blue."""

    def work(p: np.ndarray) -> np.ndarray:
        w, h = target_size(p.shape[1], p.shape[0], resolution, scale)
        return resampled(p, max(h, 1), max(w, 1))

    out = _decoded(_images(spark, path), work)
    return out.select("path", last_number().alias("frame"), "h", "w", "channels", "data")


def joined_stacks(masks: DataFrame, frames: DataFrame) -> DataFrame:
    """``(frame, idx, h, w, data)``: the bit-packed masks of a frame's prompts as one stack.

    ``masks`` is (frame, prompt, idx, h, w, data), ``frames`` (frame, h, w).
    Masks come in order of prompt and idx; of equal ones the first stays.  A mask
    whose sides are a frame's the other way round is turned; other shapes raise.
    A frame without masks has no rows.
    """
    shape = frames.select(F.col("frame").alias("_of"), F.col("h").alias("_h"), F.col("w").alias("_w"))
    rows = masks.join(shape, F.col("frame") == F.col("_of")).select("frame", "prompt", "idx", "h", "w", "data", "_h", "_w")
    kinds = {c: masks.schema[c].dataType.simpleString() for c in ("frame", "prompt")}

    def turn(batches):
        for batch in batches:
            data = []
            for r in batch.select(["h", "w", "data", "_h", "_w"]).to_pylist():
                if (r["h"], r["w"]) == (r["_h"], r["_w"]):
                    data.append(r["data"])
                elif (r["w"], r["h"]) == (r["_h"], r["_w"]):
                    data.append(np.packbits(np.unpackbits(np.frombuffer(r["data"], np.uint8), count=r["h"] * r["w"]).reshape(r["h"], r["w"]).T).tobytes())
                else:
                    raise ValueError(f"a mask of {r['h']} x {r['w']} for a frame of {r['_h']} x {r['_w']}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("frame", "prompt", "idx", "_h", "_w")), pa.array(data, pa.binary())], ["frame", "prompt", "idx", "h", "w", "data"])

    from pyspark.sql import Window

    whole = rows.mapInArrow(turn, f"frame {kinds['frame']}, prompt {kinds['prompt']}, idx int, h int, w int, data binary")
    first = whole.groupBy("frame", "data").agg(F.min(F.struct("prompt", "idx", "h", "w")).alias("at"))
    at = F.row_number().over(Window.partitionBy("frame").orderBy("at.prompt", "at.idx")) - 1
    return first.select("frame", at.cast("int").alias("idx"), F.col("at.h").alias("h"), F.col("at.w").alias("w"), "data")


def packed_overlaps(left: DataFrame, right: DataFrame, on: str = "frame") -> DataFrame:
    """``(on, idx, other, inter, pred, gt)`` of every two bit-packed masks of a frame: set bits in both and in each."""

    def count(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[c], np.uint8) for c in ("data", "_data"))
                out.append((int(np.bitwise_count(a & b).sum()), int(np.bitwise_count(a).sum()), int(np.bitwise_count(b).sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (on, "idx", "other")), *(pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 3))], [on, "idx", "other", "inter", "pred", "gt"])

    both = left.select(on, "idx", "data").join(right.select(F.col(on).alias("_on"), F.col("idx").alias("other"), F.col("data").alias("_data")), F.col(on) == F.col("_on")).drop("_on")
    return both.mapInArrow(count, f"{on} {left.schema[on].dataType.simpleString()}, idx int, other int, inter long, pred long, gt long")
