"""Where the cameras of scenes stand, and moving them, and points, into a common frame.

A camera holds the transposed rotation ``r`` and the translation ``t`` of its
view, so its centre is ``-r t``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import rigid as rg


def _rotation(rotation: str) -> rg.Matrix:
    return [rg.vector(F.get(rotation, i)) for i in range(3)]


def centre(rotation: str = "rotation", translation: str = "translation") -> rg.Vector:
    """A camera's centre."""
    return rg.scaled(rg.times(_rotation(rotation), rg.vector(F.col(translation))), -1.0)


def bounds(cameras: DataFrame, scene: str = "scene") -> DataFrame:
    """``(scene, middle, radius)``: the mean of a scene's camera centres and the largest distance of one to it."""
    at = cameras.select(F.col(scene).alias("scene"), *(c.alias(f"c{i}") for i, c in enumerate(centre())))
    middle = at.groupBy("scene").agg(F.array(*(F.avg(f"c{i}") for i in range(3))).alias("middle"))
    away = [F.col(f"c{i}") - F.get("middle", i) for i in range(3)]
    joined = at.join(middle.withColumnRenamed("scene", "_scene"), F.col("scene").eqNullSafe(F.col("_scene")))
    return joined.groupBy("scene").agg(F.first("middle").alias("middle"), F.max(F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2])).alias("radius"))


def placed(point: rg.Vector, middle: Column, divisor: Column) -> rg.Vector:
    """A point seen from ``middle``, in units of ``divisor``; null where that is 0."""
    return [F.try_divide(point[i] - F.get(middle, i), divisor) for i in range(3)]


def placed_cameras(cameras: DataFrame, frames: DataFrame, scene: str = "scene") -> DataFrame:
    """Cameras with their centres moved into their scene's frame ``(scene, middle, divisor)``; those of a scene without one stay."""
    named = frames.select(F.col("scene").alias("_scene"), F.col("middle").alias("_middle"), F.col("divisor").alias("_divisor"))
    moved = placed(centre(), F.col("_middle"), F.col("_divisor"))
    back = rg.scaled(rg.times(rg.transposed(_rotation("rotation")), moved), -1.0)
    joined = cameras.join(named, F.col(scene).eqNullSafe(F.col("_scene")), "left")
    new = F.when(F.col("_middle").isNull(), F.col("translation")).otherwise(F.array(*back))
    return joined.withColumn("translation", new).select(cameras.columns)


def placed_points(points: DataFrame, frames: DataFrame, scene: str = "scene") -> DataFrame:
    """Points ``xyz`` moved as ``placed_cameras`` moves cameras."""
    named = frames.select(F.col("scene").alias("_scene"), F.col("middle").alias("_middle"), F.col("divisor").alias("_divisor"))
    joined = points.join(named, F.col(scene).eqNullSafe(F.col("_scene")), "left")
    new = F.when(F.col("_middle").isNull(), F.col("xyz")).otherwise(F.array(*placed(rg.vector(F.col("xyz")), F.col("_middle"), F.col("_divisor"))))
    return joined.withColumn("xyz", new).select(points.columns)
