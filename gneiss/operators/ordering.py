"""Positions in a global order, and repeatable samples, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.storage import materialise


def positions(rows: DataFrame, order: list[str], name: str = "at") -> DataFrame:
    """Adds the place of each row, from 0, in the order of ``order``, which must tell rows apart.

    Rows are dealt into ranges of the order and written once; a place is the
    number of rows in the ranges before plus the place in its own range, so no
    task sorts more than a range.  Only one count a range is summed in one task.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranged.join(starts, F.col("_range") == F.col("_of"))  # one row a range
    return placed.withColumn(name, F.col("_start") + own - 1).drop("_range", "_of", "_start")


def uniform(*keys: Column) -> Column:
    """A repeatable uniform variate in [0, 1) for each key, from 52 bits of its MD5."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
