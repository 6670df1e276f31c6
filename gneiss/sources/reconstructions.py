"""Binary files of sparse and dense reconstructions as tables.

Records have no fixed size and files no index, so a file is one task's; what a
task holds is the file's bytes and one batch of rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: camera models by number, with their parameters.
MODELS = [
    ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8), ("FULL_OPENCV", 12), ("FOV", 5),
    ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12),
]
BATCH = 10_000


def _rows(content: bytes, one: Callable[[bytes, int], tuple[tuple, int]]) -> Iterator[tuple]:
    """The records behind a leading count."""
    (count,) = struct.unpack_from("<Q", content)
    at = 8
    for _ in range(count):
        row, at = one(content, at)
        yield row


def _point(content: bytes, at: int) -> tuple[tuple, int]:
    id_, x, y, z, r, g, b, error, n = struct.unpack_from("<Q3d3BdQ", content, at)
    return (id_, [x, y, z], [r, g, b], error), at + 51 + 8 * n


def _camera(content: bytes, at: int) -> tuple[tuple, int]:
    id_, model, width, height = struct.unpack_from("<iiQQ", content, at)
    name, n = MODELS[model]
    return (id_, name, width, height, list(struct.unpack_from(f"<{n}d", content, at + 24))), at + 24 + 8 * n


def _image(content: bytes, at: int) -> tuple[tuple, int]:
    id_, *pose, camera = struct.unpack_from("<i7di", content, at)
    end = content.index(b"\0", at + 64)
    (n,) = struct.unpack_from("<Q", content, end + 1)
    seen = np.frombuffer(content, np.dtype([("xy", "<f8", 2), ("id", "<i8")]), n, end + 9)
    return (id_, pose[:4], pose[4:], camera, content[at + 64 : end].decode(), seen["xy"].tolist(), seen["id"].tolist()), end + 9 + 24 * n


def _reader(one: Callable, names: list[str], kinds: list[pa.DataType]):
    def read(batches):
        schema = pa.schema([("path", pa.string()), *zip(names, kinds, strict=True)])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = []
                for row in _rows(content, one):
                    part.append({"path": path, **dict(zip(names, row, strict=True))})
                    if len(part) == BATCH:
                        yield pa.RecordBatch.from_pylist(part, schema=schema)
                        part = []
                yield pa.RecordBatch.from_pylist(part, schema=schema)

    return read


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


_numbers, _whole = pa.list_(pa.float64()), pa.list_(pa.int32())


def points_of(files: DataFrame) -> DataFrame:
    """``(path, id, xyz, rgb, error)`` of the sparse points in files ``(path, content)``; the images that a point is seen in are passed over."""
    read = _reader(_point, ["id", "xyz", "rgb", "error"], [pa.int64(), _numbers, _whole, pa.float64()])
    return files.mapInArrow(read, "path string, id long, xyz array<double>, rgb array<int>, error double")


def cameras_of(files: DataFrame) -> DataFrame:
    """``(path, id, model, width, height, params)`` of the cameras, of all eleven models, in files ``(path, content)``."""
    read = _reader(_camera, ["id", "model", "width", "height", "params"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), _numbers])
    return files.mapInArrow(read, "path string, id long, model string, width long, height long, params array<double>")


def images_of(files: DataFrame) -> DataFrame:
    """``(path, id, rotation, translation, camera_id, name, points, point_ids)`` of the posed images in files ``(path, content)``."""
    names = ["id", "rotation", "translation", "camera_id", "name", "points", "point_ids"]
    read = _reader(_image, names, [pa.int64(), _numbers, _numbers, pa.int64(), pa.string(), pa.list_(_numbers), pa.list_(pa.int64())])
    kinds = "id long, rotation array<double>, translation array<double>, camera_id long, name string, points array<array<double>>, point_ids array<long>"
    return files.mapInArrow(read, f"path string, {kinds}")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``(id, xyz, rgb, error)`` of sparse points."""
    return points_of(_files(spark, path)).drop("path")


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``(id, model, width, height, params)`` of cameras of all eleven models."""
    return cameras_of(_files(spark, path)).drop("path")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(id, rotation, translation, camera_id, name, points, point_ids)`` of posed images."""
    return images_of(_files(spark, path)).drop("path")


def posed_cameras(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each image with its camera's model, size and parameters; images are numbered by name."""
    named = cameras.select(F.col("id").alias("_camera"), "model", "width", "height", "params")
    return images.join(named, F.col("camera_id") == F.col("_camera")).drop("_camera")


def _grids(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            *size, values = content.split(b"&", 3)
            width, height, channels = map(int, size)
            grid = np.frombuffer(values, "<f4").reshape(channels, height, width)  # the first index runs fastest
            for y in range(height):
                yield pa.RecordBatch.from_pylist([{"path": path, "y": y, "values": grid[:, y, :].T.astype(float).tolist()}], schema=pa.schema([("path", pa.string()), ("y", pa.int32()), ("values", pa.list_(_numbers))]))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """``(path, y, values)`` of dense maps, a row of pixels each: ``values[x]`` has a number for each channel."""
    return _files(spark, path).mapInArrow(_grids, "path string, y int, values array<array<double>>")
