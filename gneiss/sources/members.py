"""Sinks of whole files: arrays, mask stacks, ZIP bundles and PNG images, under their final names only when whole."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gneiss.operators.ordering import positions
from gneiss.sources.ply import _store

_MEMBER = pa.schema([("file", pa.string()), ("member", pa.string()), ("content", pa.binary())])


class Staged(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class MemberWriter(DataSourceWriter):
    """Rows ``(file, member, content)``, those of a file together: a file is the content of its
    one row, or with ``zip`` an archive of its members.

    A task writes under names of its own attempt; the commit gives files their
    names, in place of those that were there.  What a failed attempt left
    behind is under no file's name, and what a failed job wrote is deleted.
    """

    def __init__(self, path: str, archives: bool):
        self.path, self.archives = path.rstrip("/"), archives

    def write(self, iterator):
        store, folder = _store(self.path)
        store.create_dir(folder)
        moves, name, stream, bundle = [], None, None, None

        def close():
            if bundle:
                bundle.close()
            if stream:
                stream.close()

        for row in iterator:
            if row["file"] != name:
                close()
                name, target = row["file"], f"{folder}/{row['file']}"
                if "/" in name:
                    store.create_dir(target.rsplit("/", 1)[0])
                moves.append((f"{target}.{uuid.uuid4().hex}.part", target))
                stream = store.open_output_stream(moves[-1][0])
                bundle = zipfile.ZipFile(stream, "w") if self.archives else None
            elif not self.archives:
                raise ValueError(f"two contents for {name}")
            if bundle:
                bundle.writestr(row["member"], row["content"])
            else:
                stream.write(row["content"])
        close()
        return Staged(moves)

    def commit(self, messages):
        store, _ = _store(self.path)
        for staged, target in (move for m in messages if m for move in m.moves):
            if store.get_file_info(target).type == fs.FileType.File:
                store.delete_file(target)
            store.move(staged, target)

    def abort(self, messages):
        store, _ = _store(self.path)
        for staged, _ in (move for m in messages if m for move in m.moves):
            if store.get_file_info(staged).type == fs.FileType.File:
                store.delete_file(staged)


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return "file string, member string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> MemberWriter:
        return MemberWriter(self.options["path"], self.options.get("zip", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MemberSource)


def write_files(files: DataFrame, path: str) -> None:
    """``(file, content)``: a file a row."""
    rows = files.select("file", F.lit("").alias("member"), "content")
    rows.write.format("members").mode("append").save(path)


def write_archives(members: DataFrame, path: str) -> None:
    """``(file, member, content)``: a ZIP archive a file; its members, in order of their names, pass through one task one by one."""
    rows = members.select("file", "member", "content").repartition("file").sortWithinPartitions("file", "member")
    rows.write.format("members").mode("append").option("zip", "true").save(path)


def _npy(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


def write_npy(df: DataFrame, path: str, column: str, order: list[str], kind: str = "int32", part_rows: int = 4_000_000) -> None:
    """A column in the order of ``order`` as .npy files ``part-00000.npy`` and so on of ``part_rows`` values each; their
    concatenation in order of names is the array, a single file where it is no longer than that."""
    placed = positions(df.select(column, *(c for c in order if c != column)), order).select((F.col("at") / part_rows).cast("int").alias("part"), "at", F.col(column).alias("value"))

    def pack(table: pa.Table) -> pa.Table:
        values = table.sort_by("at").column("value").to_numpy().astype(kind)
        return pa.Table.from_pylist([{"file": f"part-{table.column('part')[0].as_py():05d}.npy", "member": "", "content": _npy(values)}], schema=_MEMBER)

    write_files(placed.groupBy("part").applyInArrow(pack, "file string, member string, content binary"), path)


def stack_members(masks: DataFrame) -> DataFrame:
    """``(file, member, content)``: the masks ``(path, key, idx, h, w, data)`` of each key as a boolean stack ``key.npy``,
    in order of idx.  A stack is what one member holds, so it is put together in one group; shapes that differ raise."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        shapes = set(zip(table.column("h").to_pylist(), table.column("w").to_pylist(), strict=True))
        path, key = table.column("path")[0].as_py(), table.column("key")[0].as_py()
        if len(shapes) > 1:
            raise ValueError(f"{path}: masks of {key} have the shapes {sorted(shapes)}")
        h, w = shapes.pop()
        stack = np.stack([np.unpackbits(np.frombuffer(d, np.uint8), count=h * w).reshape(h, w) for d in table.column("data").to_pylist()])
        return pa.Table.from_pylist([{"file": path, "member": f"{key}.npy", "content": _npy(stack.astype(bool))}], schema=_MEMBER)

    return masks.groupBy("path", "key").applyInArrow(pack, "file string, member string, content binary")


def write_mask_stacks(masks: DataFrame, path: str) -> None:
    """.npz files named by ``path``, as ``read_mask_stacks`` reads them."""
    write_archives(stack_members(masks), path)


def write_bundled_stacks(masks: DataFrame, path: str, bundle: str = "masks.zip") -> None:
    """One ZIP file of .npz members, as ``read_bundled_stacks`` reads it."""

    def pack(table: pa.Table) -> pa.Table:
        table, out = table.sort_by("member"), io.BytesIO()
        with zipfile.ZipFile(out, "w") as npz:
            for member, content in zip(table.column("member").to_pylist(), table.column("content").to_pylist(), strict=True):
                npz.writestr(member, content)
        return pa.Table.from_pylist([{"file": bundle, "member": table.column("file")[0].as_py(), "content": out.getvalue()}], schema=_MEMBER)

    write_archives(stack_members(masks).groupBy("file").applyInArrow(pack, "file string, member string, content binary"), path)


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width) grey or (height, width, 3) colour bytes; rows are stored as differences to the row above."""
    height, width = pixels.shape[:2]
    lines = pixels.reshape(height, -1)
    above = np.vstack([np.zeros_like(lines[:1]), lines[:-1]])
    filtered = np.column_stack([np.full(height, 2, np.uint8), lines - above])

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + chunk(b"IEND", b"")


def write_id_maps(rows: DataFrame, path: str, name: str = "image") -> None:
    """Images of ``(name, y, bytes)`` rows, as ``id_map_rows`` gives them: one PNG ``<name>.png`` an image, y rising."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        lines = [np.frombuffer(b, np.uint8) for b in table.column("bytes").to_pylist()]
        return pa.Table.from_pylist([{"file": f"{table.column(name)[0].as_py()}.png", "member": "", "content": png(np.stack(lines))}], schema=_MEMBER)

    write_files(rows.select(name, "y", "bytes").groupBy(name).applyInArrow(pack, "file string, member string, content binary"), path)
