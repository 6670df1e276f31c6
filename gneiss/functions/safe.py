"""Arithmetic that gives a value where plain operators raise or give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """num / den as double, ``otherwise`` where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(otherwise))


def iou(inter: Column, pred: Column, gt: Column) -> Column:
    """Intersection over union from counts; 0 for an empty union."""
    return ratio(inter, pred + gt - inter)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 where either side does not vary."""
    vx, vy = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n)
    flat = (F.sqrt(F.greatest(vx, F.lit(0.0))) <= 1e-9) | (F.sqrt(F.greatest(vy, F.lit(0.0))) <= 1e-9)
    return F.when(flat, F.lit(0.0)).otherwise(ratio(sxy / n - (sx / n) * (sy / n), F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))


def f6(x: Column) -> Column:
    """Six decimal places: what differs between engines lies beyond."""
    return F.round(x, 6)
