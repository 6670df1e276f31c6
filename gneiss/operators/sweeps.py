"""Results of sweeps that are computed once for a setting and what it was computed from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.storage import materialise


def fingerprints(inputs: DataFrame, on: str) -> DataFrame:
    """``(on, _n, _sum, _xor)``: what the rows of each group are, whatever their order; one aggregate, at most a row a group a task shuffled."""
    columns = [F.col(c) for c in inputs.columns]
    row = F.xxhash64(*columns, *(c.isNull() for c in columns))
    return inputs.groupBy(on).agg(F.count("*").alias("_n"), F.sum(row.cast("decimal(20,0)")).alias("_sum"), F.bit_xor(row).alias("_xor"))


def _kept(spark, path: str) -> DataFrame | None:
    """The results of the first run that has a key."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:  # nothing has been written yet
        return None
    first = rows.groupBy(F.col("_key").alias("_of")).agg(F.min("run").alias("_first"))
    return rows.join(first, (F.col("_key") == F.col("_of")) & (F.col("run") == F.col("_first"))).drop("_of", "_first", "run")


def cached(path: str, wanted: DataFrame, inputs: DataFrame, on: str, compute: Callable[[DataFrame], DataFrame], version: str = "1") -> DataFrame:
    """``compute`` of the settings ``wanted``, read from the table in ``path`` where it has been computed before.

    A result's key is a hash of all columns of its setting, of ``version`` and
    of the rows of ``inputs`` with the setting's ``on``; so a changed input has the settings of its own group computed again.
    ``compute`` takes the missing settings with their ``_key`` and hands the key on with
    each row of a result; a setting without rows is computed each time.  A run
    is seen under its folder's final name only when it is whole.
    """
    spark, settings = wanted.sparkSession, sorted(wanted.columns)
    prints = fingerprints(inputs, on).withColumnRenamed(on, "_on")
    text = F.to_json(F.struct(F.lit(version).alias("_version"), *settings, "_n", F.col("_sum").cast("string").alias("_sum"), "_xor"), {"ignoreNullFields": "false"})
    asked = wanted.distinct().join(prints, F.col(on).eqNullSafe(F.col("_on")), "left").withColumn("_key", F.sha2(text, 256)).select("_key", *settings)
    asked = materialise(asked, "asked")
    before = _kept(spark, path)
    missing = asked if before is None else asked.join(before.select("_key").distinct(), "_key", "left_anti")
    missing = materialise(missing, "missing")
    if before is None or not missing.isEmpty():
        run, paths = uuid.uuid4().hex, spark._jvm.org.apache.hadoop.fs.Path
        staged, final = paths(f"{path.rstrip('/')}/_staged-{run}"), paths(f"{path.rstrip('/')}/run=r{run}")
        compute(missing).write.parquet(staged.toString())
        if not staged.getFileSystem(spark._jsc.hadoopConfiguration()).rename(staged, final):
            raise RuntimeError(f"{final.toString()} could not be named")
    return _kept(spark, path).join(asked.select("_key"), "_key", "left_semi").drop("_key")
