"""Rigid motions, cameras and spherical harmonics as column expressions.

A vector is a list of three columns, a matrix a list of its rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]
Matrix = list[Vector]


def vector(array: Column, begin: int = 0) -> Vector:
    return [F.get(array, begin + i) for i in range(3)]


def times(m: Matrix, v: Vector) -> Vector:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m]


def transposed(m: Matrix) -> Matrix:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def plus(a: Vector, b: Vector) -> Vector:
    return [p + q for p, q in zip(a, b, strict=True)]


def scaled(v: Vector, by) -> Vector:
    return [x * by for x in v]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def quaternion_of(r: Matrix) -> Vector:
    """Unit quaternion (w, x, y, z), w at least 0, of a rotation.

    The component of largest magnitude comes from the diagonal; the others from
    sums and differences across it, divided by the largest.
    """
    square = [1 + r[0][0] + r[1][1] + r[2][2], 1 + r[0][0] - r[1][1] - r[2][2], 1 - r[0][0] + r[1][1] - r[2][2], 1 - r[0][0] - r[1][1] + r[2][2]]
    half = [F.sqrt(F.greatest(s, F.lit(0.0))) / 2 for s in square]
    difference = [r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]]
    total = {(1, 2): r[0][1] + r[1][0], (1, 3): r[0][2] + r[2][0], (2, 3): r[1][2] + r[2][1]}

    def given(top: int) -> Column:
        """The quaternion when ``top`` is the largest component."""
        parts = []
        for i in range(4):
            if i == top:
                parts.append(half[i])
            elif 0 in (i, top):
                parts.append(difference[max(i, top) - 1] / (4 * half[top]))
            else:
                parts.append(total[min(i, top), max(i, top)] / (4 * half[top]))
        return F.array(*parts)

    most = F.greatest(*square)
    q = F.when(square[0] == most, given(0)).when(square[1] == most, given(1)).when(square[2] == most, given(2)).otherwise(given(3))
    sign = F.when(F.get(q, 0) < 0, -1.0).otherwise(1.0)
    return [F.get(q, i) * sign for i in range(4)]


def euler_quaternion(x: float, y: float, z: float) -> list[float]:
    """Quaternion of the rotation about x after y after z, angles in radians."""
    q = [1.0, 0.0, 0.0, 0.0]
    for axis, angle in enumerate((x, y, z)):
        p = [math.cos(angle / 2), 0.0, 0.0, 0.0]
        p[1 + axis] = math.sin(angle / 2)
        (a, b, c, d), (e, f, g, h) = q, p
        q = [a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e]
    return [-v for v in q] if q[0] < 0 else q


def moved_view(r: Matrix, t: Vector, move: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: float = 1.0) -> Vector:
    """The view's translation once its centre is moved and then scaled.

    A camera has the rotation transposed(r) and the translation t; its centre is -r t.
    """
    centre = scaled(plus(scaled(times(r, t), -1), [F.lit(m) for m in move]), scale)
    return scaled(times(transposed(r), centre), -1)


def projection(near: float, far: float, fov_x: Column, fov_y: Column) -> dict[tuple[int, int], Column]:
    """The non-zero entries of the perspective matrix, z from 0 at near to 1 at far."""
    return {
        (0, 0): 1 / F.tan(fov_x / 2), (1, 1): 1 / F.tan(fov_y / 2), (2, 2): F.lit(far / (far - near)), (2, 3): F.lit(-far * near / (far - near)), (3, 2): F.lit(1.0),
    }


def screw_translation(w: Vector, v: Vector, angle: Column) -> Vector:
    """What a screw motion (w, v) of a magnitude moves the origin by."""
    once = cross(w, v)
    return plus(plus(scaled(v, angle), scaled(once, 1 - F.cos(angle))), scaled(cross(w, once), angle - F.sin(angle)))


def rotation_log(r: Matrix) -> tuple[Vector, Column]:
    """Axis and angle of a rotation; the angle is kept off 0 by 1e-5."""
    angle = F.acos((r[0][0] + r[1][1] + r[2][2] - 1) / 2) + 1e-5
    return scaled([r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]], 1 / (2 * F.sin(angle))), angle


def screw_log(r: Matrix, p: Vector) -> tuple[Vector, Vector, Column]:
    """``(w, v, angle)`` of a rigid motion: v solves the motion's 3 x 3 system by cross products of its columns."""
    w, angle = rotation_log(r)
    unit = [[F.lit(float(i == j)) for i in range(3)] for j in range(3)]
    a, b, c = (screw_translation(w, e, angle) for e in unit)  # the system's columns
    whole = a[0] * cross(b, c)[0] + a[1] * cross(b, c)[1] + a[2] * cross(b, c)[2]
    part = lambda x: (p[0] * x[0] + p[1] * x[1] + p[2] * x[2]) / whole
    return w, [part(cross(b, c)), part(cross(c, a)), part(cross(a, b))], angle


def harmonic_terms(degree: int) -> list[tuple[int, float, list[float]]]:
    """``(m, factor, polynomial in z)`` of the real spherical harmonics up to a degree, m from -l to l.

    The polynomial is the |m|th derivative of the Legendre polynomial; the
    factor normalises, with the alternating sign of odd m.
    """
    out = []
    for l in range(degree + 1):
        legendre = np.polynomial.legendre.Legendre.basis(l).convert(kind=np.polynomial.Polynomial)
        for m in range(-l, l + 1):
            k = abs(m)
            size = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - k) / math.factorial(l + k) * (2 if k else 1))
            out.append((m, (-1) ** k * size, [float(c) for c in (legendre.deriv(k) if k else legendre).coef]))
    return out


def harmonic_value(coefficients: Column, direction: Vector, degree: int) -> Column:
    """The sum of spherical harmonics at a unit direction, coefficients in order of degree and m."""
    x, y, z = direction
    real, imaginary = [F.lit(1.0)], [F.lit(0.0)]  # powers of x + iy
    for _ in range(degree):
        real, imaginary = [*real, x * real[-1] - y * imaginary[-1]], [*imaginary, x * imaginary[-1] + y * real[-1]]
    total = F.lit(0.0)
    for i, (m, factor, polynomial) in enumerate(harmonic_terms(degree)):
        height = F.lit(polynomial[-1])
        for c in polynomial[-2::-1]:
            height = height * z + c
        total = total + F.get(coefficients, i) * factor * height * (real[m] if m >= 0 else imaginary[-m])
    return total
