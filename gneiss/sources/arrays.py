"""Arrays in .npy and .npz files, read by Spark and decoded in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _vectors(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            values = np.load(io.BytesIO(content), allow_pickle=False).ravel()
            for at in range(0, len(values), 65_536):
                part = values[at : at + 65_536].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["path", "id", "value"])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(path, id, value)`` of every element of one-dimensional .npy files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_vectors, "path string, id long, value double")


_MASK = pa.schema([("path", pa.string()), ("key", pa.string()), ("idx", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())])


def _masks(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield from _stacks(path, content)


def _stacks(path: str, content: bytes):
    with np.load(io.BytesIO(content), allow_pickle=False) as stack:
        for key in stack.files:
            masks = stack[key]
            if masks.ndim == 2:
                masks = masks[None]
            if masks.ndim != 3:
                raise ValueError(f"{path}: {key} has {masks.ndim} dimensions")
            rows = [(path, key, i, m.shape[0], m.shape[1], np.packbits(m.astype(bool)).tobytes()) for i, m in enumerate(masks)]
            yield pa.RecordBatch.from_pylist([dict(zip(_MASK.names, r, strict=True)) for r in rows], schema=_MASK)


def read_mask_stacks(spark: SparkSession, path: str) -> DataFrame:
    """``(path, key, idx, h, w, data)``: each mask of the stacks in .npz files, bit-packed.

    A two-dimensional array is a stack of one; other ranks raise.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_masks, "path string, key string, idx int, h int, w int, data binary")


def _members(pattern: str):
    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    for name in sorted(n for n in bundle.namelist() if re.search(pattern, n)):
                        yield from _stacks(f"{path}!{name}", bundle.read(name))

    return read


def read_bundled_stacks(spark: SparkSession, path: str, pattern: str = r"\.npz$") -> DataFrame:
    """As ``read_mask_stacks``, of the .npz members of ZIP files whose names match ``pattern``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_members(pattern), "path string, key string, idx int, h int, w int, data binary")


def _table_rows(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            values = np.load(io.BytesIO(content), allow_pickle=False)
            if values.ndim != 2:
                raise ValueError(f"{path}: {values.ndim} dimensions, not two")
            for at in range(0, len(values), 65_536):
                part = values[at : at + 65_536].astype(np.float64)
                flat = pa.ListArray.from_arrays(np.arange(0, part.size + 1, values.shape[1] or 1, dtype=np.int32)[: len(part) + 1], pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), flat], ["path", "at", "values"])


def rows_of(files: DataFrame) -> DataFrame:
    """``(path, at, values)``: each row of the two-dimensional .npy files ``(path, content)``; other ranks raise."""
    return files.mapInArrow(_table_rows, "path string, at long, values array<double>")
