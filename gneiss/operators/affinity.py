"""Nearest-neighbour affinity graphs over point primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.safe import dot, norm
from gneiss.storage import materialise


def _cells(edge: float) -> list[Column]:
    return [F.floor(F.col(c) / edge).alias(f"c{c}") for c in "xyz"]


def _crowded(base: DataFrame, edge: float, most: int) -> DataFrame:
    """Cells that hold more than ``most`` rows."""
    return base.groupBy(*_cells(edge)).agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n")


def _dealt_by_depth(todo: DataFrame, base: DataFrame, edge: float, most: int, deepest: int) -> list[DataFrame]:
    """Points by the level they start at: the first whose cell, of half the edge of the level
    before, holds at most ``most`` rows of ``base``."""
    levels, keys = [], ["cx", "cy", "cz"]
    for level in range(deepest):
        cells = _cells(edge / 2**level)
        dense = materialise(_crowded(base, edge / 2**level, most), "knn-dense")
        if dense.isEmpty():
            break
        keyed = todo.select("*", *cells)
        levels.append(materialise(keyed.join(dense, keys, "left_anti").select(todo.columns), "knn-level"))
        todo = materialise(keyed.join(dense, keys, "left_semi").select(todo.columns), "knn-level")
        base = materialise(base.select("*", *cells).join(dense, keys, "left_semi").select(base.columns), "knn-level")
    return [*levels, todo]


def nearest(points: DataFrame, k: int, targets: DataFrame | None = None, include: int = 8, max_rounds: int = 40, most: int = 256, deepest: int = 24) -> DataFrame:
    """``(src, dst, d2, rank)``: the exact k nearest other points in three dimensions, ties to smaller ids.

    Neighbours are sought among ``targets``, by default the points themselves.

    Points fall in cubic cells; a point meets the points of its 27 cells, and is
    settled when its kth distance is at most the cell's edge, since all nearer
    points are then among those met.  Those that are not settled go on with
    cells twice as wide.  The first edge follows from the density, about
    ``include`` points a cell; where a cell holds more than ``most``, its points
    start with cells of half the edge, again and again, so points that lie close
    together meet few of their like.  Of such targets in one place only the k + 1
    smallest ids are met, as no other can be among the k nearest of any point.
    Points with a null coordinate take no part; with k or fewer other points all
    of them are neighbours.
    """
    whole = lambda df: materialise(df.select("id", "x", "y", "z").where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"), "knn-points")
    todo = whole(points)
    base = todo if targets is None else whole(targets)
    n, *ends = base.agg(F.count("*"), *(f(c) for c in "xyz" for f in (F.min, F.max))).first()
    if n < 2 and targets is None or not n:
        return base.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
    spans = [max(b - a, 1e-9) for a, b in zip(ends[::2], ends[1::2], strict=True)]
    first = max((spans[0] * spans[1] * spans[2] * include / n) ** (1 / 3), max(spans) / 2**20)
    waiting, most = [todo], max(most, k + 1)
    if not _crowded(base, first, most).isEmpty():
        place = F.dense_rank().over(Window.partitionBy("x", "y", "z").orderBy("id"))
        base = materialise(base.withColumn("_at", place).where(F.col("_at") <= k + 1).drop("_at"), "knn-targets")
        waiting = _dealt_by_depth(todo, base, first, most, deepest)
    done, want = [], min(k, n - 1 if targets is None else n)
    edge, todo = first / 2 ** (len(waiting) - 1), waiting.pop()
    for _ in range(max_rounds + len(waiting)):
        cell = lambda c: F.floor(F.col(c) / edge)  # noqa: E731, B023
        grid = base.select(F.col("id").alias("dst"), *(F.col(c).alias(f"{c}2") for c in "xyz"), *_cells(edge))
        around = todo.select("id", "x", "y", "z", *(F.explode(F.array(*(cell(c) + s for s in (-1, 0, 1)))).alias(f"c{c}") for c in "x"))
        for c in "yz":
            around = around.withColumn(f"c{c}", F.explode(F.array(*(cell(c) + s for s in (-1, 0, 1)))))
        d2 = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "yz"), (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")))
        met = around.join(grid, ["cx", "cy", "cz"]).where("id <> dst").select(F.col("id").alias("src"), "dst", d2.alias("d2"))
        rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
        close = materialise(met.withColumn("rank", rank).where(F.col("rank") <= k), "knn-met")
        settled = close.groupBy("src").agg(F.max("rank").alias("c"), F.max("d2").alias("far")).where((F.col("c") >= want) & (F.col("far") <= edge * edge))
        settled = materialise(settled.select(F.col("src").alias("ok")), "knn-settled")
        done.append(close.join(settled, F.col("src") == F.col("ok"), "left_semi"))
        todo = materialise(todo.join(settled, F.col("id") == F.col("ok"), "left_anti"), "knn-todo")
        if waiting:
            todo = todo.union(waiting.pop())
        elif todo.isEmpty():
            break
        edge *= 2
    else:
        raise RuntimeError(f"points without {want} neighbours after {max_rounds} rounds")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def gather(edges: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Attributes of both ends of each edge, as ``<column>_i`` and ``<column>_j``."""
    ends = points.select("id", *columns)
    for end, side in (("src", "i"), ("dst", "j")):
        named = ends.select(F.col("id").alias("_end"), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        edges = edges.join(named, F.col(end) == F.col("_end")).drop("_end")
    return edges


def gaussian(d2: Column, sigma: float) -> Column:
    return F.exp(-d2 / (2 * sigma * sigma))


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)


def scale_affinity(a: Column, b: Column, sigma: float) -> Column:
    """Likeness of two scales by the logarithm of the ratio of their norms, floored at 1e-6."""
    r = F.log(F.greatest(norm(a), F.lit(1e-6)) / F.greatest(norm(b), F.lit(1e-6)))
    return F.exp(-(r * r) / (2 * sigma * sigma))


def rotation_rows(q: Column) -> list[list[Column]]:
    """3 x 3 rotation of a quaternion (w, x, y, z), normalised first."""
    n = norm(q)
    w, x, y, z = (F.get(q, i) / n for i in range(4))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def principal_axis(scale: Column, q: Column) -> Column:
    """The rotation's column at the largest scale, the first of equal ones."""
    at = F.array_position(scale, F.array_max(scale))
    return F.array(*(F.element_at(F.array(*row), at.cast("int")) for row in rotation_rows(q)))


def covariance(scale: Column, q: Column) -> list[Column]:
    """Upper six entries of R S S R^T."""
    r = rotation_rows(q)
    s2 = [F.get(scale, i) * F.get(scale, i) for i in range(3)]
    entry = lambda a, b: r[a][0] * r[b][0] * s2[0] + r[a][1] * r[b][1] * s2[1] + r[a][2] * r[b][2] * s2[2]
    return [entry(a, b) for a in range(3) for b in range(a, 3)]


def centred(traj: Column, times: int) -> Column:
    """A trajectory of ``times`` x 3 numbers less its mean on each axis."""
    mean = lambda axis: F.aggregate(F.filter(traj, lambda _, i: i % 3 == axis), F.lit(0.0), lambda acc, v: acc + v) / times
    means = F.array(*(mean(a) for a in range(3)))
    return F.transform(traj, lambda v, i: v - F.get(means, i % 3))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge with the larger weight; parallel edges are summed first, zeros go."""
    summed = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    both = summed.unionByName(summed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w")).where("w <> 0")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))


def normalised(edges: DataFrame) -> DataFrame:
    """w / sqrt(d_i d_j), the degrees being sums of weights; isolated points have no edges."""
    d = degrees(edges)
    out = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("di")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dj")), "dst")
    return out.where("di > 0 AND dj > 0").select("src", "dst", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def static_fusion(a: Column, ri: Column, rj: Column, threshold: float, floor: float) -> Column:
    """Two static ends: 1; one: at least the floor; none: the affinity itself."""
    si, sj = ri < threshold, rj < threshold
    return F.when(si & sj, 1.0).when(si | sj, floor + (1 - floor) * a).otherwise(a)


def fused(color: Column, orient: Column, scale: Column, use_geometry: bool = True, power: float = 1.0) -> Column:
    """The geometric mean of the likenesses of colour, orientation and scale, to a
    power; 1 without geometry, so that only the graph's structure is left."""
    w = F.pow(color * orient * scale, F.lit(1 / 3)) if use_geometry else F.lit(1.0)
    return F.pow(w, F.lit(power)) if power != 1.0 else w


def segment_max(segments: DataFrame, maps: DataFrame, edge: list[str], view: str, values: list[str], samples: int) -> DataFrame:
    """For each edge, the largest of each map value along its segments ``(xi, yi)`` to ``(xj, yj)`` over all views.

    A segment is sampled at ``samples`` evenly spaced places, ends included, and
    a place takes the mean of its four pixels by nearness; pixels that the map
    ``(view, y, x, values)`` does not have are 0.
    """
    t = F.col("_k") / max(samples - 1, 1)
    at = segments.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_k"))
    at = at.withColumn("_x", F.col("xi") * (1 - t) + F.col("xj") * t).withColumn("_y", F.col("yi") * (1 - t) + F.col("yj") * t)
    fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    corners = [F.struct((F.floor("_y") + dy).alias("y"), (F.floor("_x") + dx).alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w")) for dy in (0, 1) for dx in (0, 1)]
    near = at.select(*edge, view, "_k", F.explode(F.array(*corners)).alias("c")).where("c.w > 0").select(*edge, view, "_k", "c.y", "c.x", "c.w")
    sampled = near.join(maps, [view, "y", "x"]).groupBy(*edge, view, "_k").agg(*(F.sum(F.col("w") * F.col(v)).alias(v) for v in values))
    most = sampled.groupBy(*edge).agg(*(F.max(v).alias(v) for v in values))
    seen = segments.select(*edge).distinct()
    return seen.join(most, edge, "left").select(*edge, *(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)).alias(v) for v in values))


def boundary(depth: Column, color: Column, seen: Column, by_depth: float, by_color: float, offset: float, most: float = 0.99) -> Column:
    """How much an edge is held back: a sigmoid of what its segments cross, 0 for edges that no view shows."""
    held = 1 / (1 + F.exp(-(by_depth * depth + by_color * color - offset)))
    return F.when(seen, F.least(held, F.lit(most))).otherwise(0.0)
