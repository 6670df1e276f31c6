"""Rotations, cameras, schedules and colours as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quaternion_product(a: Column, b: Column) -> Column:
    """Hamilton product of (w, x, y, z) quaternions."""
    w1, x1, y1, z1 = (F.get(a, i) for i in range(4))
    w2, x2, y2, z2 = (F.get(b, i) for i in range(4))
    return F.array(
        w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2,
        w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
        w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2,
        w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2,
    )


def rotation_of(axis: Column, angle: Column) -> list[list[Column]]:
    """Rotation about a unit axis: I + sin(a) K + (1 - cos(a)) K^2."""
    x, y, z = (F.get(axis, i) for i in range(3))
    s, c = F.sin(angle), 1 - F.cos(angle)
    return [
        [1 + c * (-z * z - y * y), -s * z + c * x * y, s * y + c * x * z],
        [s * z + c * x * y, 1 + c * (-z * z - x * x), -s * x + c * y * z],
        [-s * y + c * x * z, s * x + c * y * z, 1 + c * (-y * y - x * x)],
    ]


def field_of_view(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def focal_length(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def _progress(step: Column, steps: int) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / steps))


def _warmed(rate: Column, step: Column, warm_steps: int, warm: float) -> Column:
    """A rate behind a quarter sine that rises from the share ``warm``; 0 before the first step."""
    if warm_steps:
        rate = rate * (warm + (1 - warm) * F.sin(math.pi / 2 * _progress(step, warm_steps)))
    return F.when(step < 0, 0.0).otherwise(rate)


def geometric_rate(step: Column, steps: int, start: float, end: float, warm_steps: int = 0, warm: float = 1.0) -> Column:
    """A rate that changes by the same factor every step, from start to end; 0 where both are."""
    if start == 0 and end == 0:
        return F.lit(0.0)
    return _warmed(start * F.pow(F.lit(end / start), _progress(step, steps)), step, warm_steps, warm)


def linear_rate(step: Column, steps: int, start: float, end: float, warm_steps: int = 0, warm: float = 1.0) -> Column:
    """A rate that changes by the same amount every step, from start to end."""
    return _warmed(start + (end - start) * _progress(step, steps), step, warm_steps, warm)


def landmark_value(step: Column, landmarks: list[int], values: list[float]) -> Column:
    """The value of the last landmark below the step, the first one's up to it."""
    below = F.size(F.filter(F.array(*map(F.lit, landmarks)), lambda x: x < step))
    return F.get(F.array(*map(F.lit, values)), F.greatest(below - 1, F.lit(0)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 luminance."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def over_background(value: Column, alpha: Column, background: float) -> Column:
    return value * alpha + background * (1 - alpha)


def reset_opacity(logit: Column, most: float = 0.01) -> Column:
    """The logit of an opacity cut at ``most``."""
    p = F.least(1 / (1 + F.exp(-logit)), F.lit(most))
    return F.log(p / (1 - p))
