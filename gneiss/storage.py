"""Intermediate tables in the folder that the whole cluster shares.

Iterative and multi-use plans are cut by writing a Parquet table below the
folder named in ``spark.checkpoint.dir``.  Such a table survives the loss of any
executor, keeps column pruning and statistics for the plans that read it, and
lets adaptive execution split skewed joins because both sides are plain scans.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str, int]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where none is, a temporary one
    of this machine when all of Spark runs on it, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _own:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        _own[key] = "file://" + tempfile.mkdtemp(prefix="spark-gneiss-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_gneiss-{key}"
    return _own[key]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    if not _written:
        atexit.register(clean)
    path = f"{shared_dir(spark)}/gneiss/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path, threading.get_ident()))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame over the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many intermediate paths there are; a mark for ``release``."""
    return len(_written)


def release(mark: int, *kept: DataFrame) -> None:
    """Delete the intermediate tables that this thread has written since ``mark``, when
    nothing will read them again, but those that the ``kept`` ones read."""
    bare = lambda path: path.removeprefix("file:").lstrip("/")
    read = {bare(f.rsplit("/", 1)[0]) for df in kept for f in df.inputFiles()}
    gone = [x for x in _written[mark:] if x[2] == threading.get_ident() and bare(x[1]) not in read]
    for spark, path, _ in gone:
        _delete(spark, path)
    paths = {x[1] for x in gone}
    _written[mark:] = [x for x in _written[mark:] if x[1] not in paths]


def clean() -> None:
    """Delete the intermediate tables of sessions that are still alive."""
    while _written:
        _delete(*_written.pop()[:2])


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # its session has ended
        with contextlib.suppress(Exception):
            store, inner = fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path))
            store.delete_dir(inner)
