"""PLY point files as a Spark data source, for reading and writing.

``spark.read.format("ply").load(path)`` after ``register(spark)``.  Binary
little-endian vertices only; a file is dealt out in stretches of whole
vertices, one partition each, and only the columns of the requested schema are
put together.
"""

from __future__ import annotations

import fnmatch
import io
import os
import re
import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

TYPES = {
    "char": ("i1", ByteType()), "int8": ("i1", ByteType()), "uchar": ("u1", ShortType()), "uint8": ("u1", ShortType()), "short": ("i2", ShortType()),
    "int16": ("i2", ShortType()), "ushort": ("u2", IntegerType()), "uint16": ("u2", IntegerType()), "int": ("i4", IntegerType()), "int32": ("i4", IntegerType()),
    "uint": ("u4", LongType()), "uint32": ("u4", LongType()), "float": ("f4", FloatType()), "float32": ("f4", FloatType()), "double": ("f8", DoubleType()), "float64": ("f8", DoubleType()),
}
STRETCH = 1 << 18
#: Bytes of a file within which its header ends.
HEADER = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, local where it names none, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if re.match("[a-z][a-z0-9]*:", path) else f"file://{os.path.abspath(path)}")


def read_header(path: str) -> tuple[int, int, list[tuple[str, str]]]:
    """Where the vertices begin, how many there are, and their (name, numpy type)."""
    store, inner = _store(path)
    with store.open_input_stream(inner) as stream:
        f = io.BytesIO(stream.read(HEADER))
    if f.readline().strip() != b"ply":
        raise ValueError(f"{path} is no PLY file")
    count, fields, inside = 0, [], False
    for raw in f:
        words = raw.decode("ascii", "replace").split()
        if words[:1] == ["format"] and words[1] != "binary_little_endian":
            raise ValueError(f"{path}: format {words[1]} is not read")
        elif words[:2] == ["element", "vertex"]:
            count, inside = int(words[2]), True
        elif words[:1] == ["element"]:
            inside = False
        elif words[:1] == ["property"] and inside:
            if words[1] == "list":
                raise ValueError(f"{path}: vertices with lists are not read")
            fields.append((words[2], "<" + TYPES[words[1]][0]))
        elif words == ["end_header"]:
            return f.tell(), count, fields
    raise ValueError(f"{path}: the header does not end")


def files_of(path: str) -> list[str]:
    """The .ply files of a folder, or those that a pattern of names in one folder matches."""
    store, inner = _store(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    folder, _, pattern = (inner, "", "*.ply") if store.get_file_info(inner).type == fs.FileType.Directory else inner.rpartition("/")
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(scheme + x.path for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern))


class Stretch(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class PlyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        out = []
        for path in files_of(self.path):
            _, count, _ = read_header(path)
            out += [Stretch(path, at, min(STRETCH, count - at)) for at in range(0, count, STRETCH)]
        return out

    def read(self, partition):
        begin, _, fields = read_header(partition.path)
        kind = np.dtype(fields)
        store, inner = _store(partition.path)
        with store.open_input_file(inner) as f:
            f.seek(begin + partition.first * kind.itemsize)
            rows = np.frombuffer(f.read(partition.count * kind.itemsize), kind)
        columns = []
        for field in self.schema.fields:
            if field.name == "id":
                columns.append(pa.array(np.arange(partition.first, partition.first + len(rows))))
            elif field.name in rows.dtype.names:
                values = np.ascontiguousarray(rows[field.name])
                columns.append(pa.array(values.astype({"smallint": "i2", "int": "i4", "bigint": "i8"}.get(field.dataType.simpleString(), values.dtype))))
            else:
                columns.append(pa.nulls(len(rows), {"float": pa.float32(), "double": pa.float64()}.get(field.dataType.simpleString(), pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema.fields])


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class PlyWriter(DataSourceWriter):
    """One file a task, under its final name only when whole."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema

    def write(self, iterator):
        names = [f.name for f in self.schema.fields if f.name != "id"]
        kinds = {"float": "f4", "double": "f8", "int": "i4", "smallint": "i2", "tinyint": "i1"}
        spoken = {"f4": "float", "f8": "double", "i4": "int", "i2": "short", "i1": "char"}
        types = {f.name: kinds[f.dataType.simpleString()] for f in self.schema.fields if f.name != "id"}
        kind, parts, count = np.dtype([(n, "<" + types[n]) for n in names]), [], 0
        iterator = iter(iterator)
        while rows := [tuple(r[n] for n in names) for r in islice(iterator, 65_536)]:  # packed part by part
            parts.append(np.array(rows, kind).tobytes())
            count += len(rows)
        if not count:
            return Written(None)
        store, folder = _store(self.path)
        store.create_dir(folder)
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *(f"property {spoken[types[n]]} {n}" for n in names), "end_header\n"]
        target = f"{folder}/part-{uuid.uuid4().hex}.ply"
        with store.open_output_stream(target + ".part") as f:
            f.write("\n".join(head).encode())
            for part in parts:
                f.write(part)
        store.move(target + ".part", target)
        return Written(target)

    def commit(self, messages):
        return None

    def abort(self, messages):
        store, _ = _store(self.path)
        for m in messages:
            if m and m.path and store.get_file_info(m.path).type == fs.FileType.File:
                store.delete_file(m.path)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        found = files_of(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        spark_types = {v[0]: v[1] for v in TYPES.values()}
        _, _, fields = read_header(found[0])
        return StructType([StructField("id", LongType()), *(StructField(n, spark_types[t[1:]]) for n, t in fields)])

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)
