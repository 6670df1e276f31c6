"""Raster kernels as sums over shifted pixels, and compositing along rays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOBEL_X = {(-1, -1): -1.0, (-1, 1): 1.0, (0, -1): -2.0, (0, 1): 2.0, (1, -1): -1.0, (1, 1): 1.0}
SOBEL_Y = {(dx, dy): w for (dy, dx), w in SOBEL_X.items()}


def convolve(pixels: DataFrame, image: list[str], kernels: dict[str, dict[tuple[int, int], float]], value: str = "v") -> DataFrame:
    """Each kernel's response at every pixel of an image, zero outside it.

    A pixel sends its value to the neighbours whose sum it enters; the sums
    combine before the shuffle, and places outside the image are left out.
    """
    offsets = sorted({o for k in kernels.values() for o in k})
    sent = F.array(*(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), *(F.lit(float(k.get((dy, dx), 0.0))).alias(n) for n, k in kernels.items())) for dy, dx in offsets))
    parts = pixels.select(*image, "y", "x", F.col(value).alias("_v"), F.explode(sent).alias("o"))
    sums = parts.groupBy(*image, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(*(F.sum(F.col("_v") * F.col(f"o.{n}")).alias(n) for n in kernels))
    return pixels.select(*image, "y", "x").join(sums, [*image, "y", "x"], "left").select(*image, "y", "x", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in kernels))


def edge_strength(pixels: DataFrame, image: list[str], value: str = "v") -> DataFrame:
    """Sobel gradient magnitude at every pixel."""
    g = convolve(pixels, image, {"gx": SOBEL_X, "gy": SOBEL_Y}, value)
    return g.select(*image, "y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("edge"))


def blur(pixels: DataFrame, image: list[str], sigma: float, value: str = "v") -> DataFrame:
    """Gaussian blur with radius ceil(3 sigma), weights summing to 1, zero outside the image."""
    r = math.ceil(3 * sigma)
    line = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    total = sum(line)
    kernel = {(dy, dx): line[dy + r] * line[dx + r] / total**2 for dy in range(-r, r + 1) for dx in range(-r, r + 1)}
    return convolve(pixels, image, {"blurred": kernel}, value)


def _sobel_edges(pixels: DataFrame, image: list[str], value: str, smooth: float = 0.0) -> DataFrame:
    """Sobel magnitude, of the blurred image where ``smooth`` is a sigma above 0."""
    if smooth > 0:
        pixels, value = blur(pixels, image, smooth, value), "blurred"
    return edge_strength(pixels, image, value)


def _ingested_edges(pixels: DataFrame, image: list[str], value: str, maps: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """Edges that a detector has found before, ``maps`` (image, y, x, edge): 0 where it has none; with a threshold 1 above it, else 0."""
    if maps is None:
        raise ValueError("ingested edges need their maps")
    if threshold is not None and not 0 < threshold < 1:
        raise ValueError(f"a threshold between 0 and 1, not {threshold}")
    found = pixels.select(*image, "y", "x").join(maps.select(*image, "y", "x", "edge"), [*image, "y", "x"], "left").withColumn("edge", F.coalesce("edge", F.lit(0.0)))
    return found if threshold is None else found.withColumn("edge", (F.col("edge") > threshold).cast("double"))


#: Ways to find edges by name.
EDGE_METHODS = {"sobel": _sobel_edges, "ingested": _ingested_edges}


def edge_maps(pixels: DataFrame, image: list[str], method: str = "sobel", value: str = "v", **options) -> DataFrame:
    """``(image, y, x, edge)`` by a method's name; unknown ones raise."""
    if method not in EDGE_METHODS:
        raise ValueError(f"no edge method {method!r}; there are {', '.join(sorted(EDGE_METHODS))}")
    return EDGE_METHODS[method](pixels, image, value, **options)


def scaled(values: DataFrame, image: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Values over their image's percentile, clipped to [0, 1]."""
    top = values.groupBy(*image).agg(F.percentile(value, F.lit(share)).alias("_top"))
    return values.join(top, image).withColumn(value, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(value) / F.greatest("_top", F.lit(1e-8))))).drop("_top")


def composited(splats: DataFrame, ray: list[str], depth: Column, alpha: Column, tie: str = "id") -> DataFrame:
    """Adds each splat's weight on its ray: alpha times what the nearer ones let through."""
    w = Window.partitionBy(*ray).orderBy(depth, tie).rowsBetween(Window.unboundedPreceding, -1)
    through = F.exp(F.coalesce(F.sum(F.log(F.greatest(1 - alpha, F.lit(1e-12)))).over(w), F.lit(0.0)))
    return splats.withColumn("weight", alpha * through)


def strongest_cluster(weighted: DataFrame, ray: list[str], k: str = "k", least: float = 0.5) -> DataFrame:
    """The cluster with the largest summed weight on each ray, the smallest id on ties; 0 below ``least``."""
    sums = weighted.groupBy(*ray, k).agg(F.sum("weight").alias("response"))
    best = sums.groupBy(*ray).agg(F.min(F.struct((-F.round("response", 12)).alias("loss"), k, "response")).alias("b"))
    return best.select(*ray, F.when(F.col("b.response") > least, F.col(f"b.{k}")).otherwise(0).alias(k), F.col("b.response").alias("response"))


def structural_likeness(pixels: DataFrame, image: list[str], height: int, width: int, a: str = "a", b: str = "b", window: int = 11, sigma: float = 1.5) -> DataFrame:
    """``(image, ssim)``: mean structural similarity of two values per pixel, on the scale 0 to 1.

    Local means, variances and the covariance are Gaussian sums over a window,
    zero outside the image, taken along y and then along x.  Pixels that no
    value reaches are equal in both and count as 1.
    """
    half = window // 2
    line = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(window)]
    sent = F.array(*(F.struct(F.lit(i - half).alias("o"), F.lit(w / sum(line)).alias("w")) for i, w in enumerate(line)))
    va, vb = F.col(a), F.col(b)
    sums = pixels.select(*image, "y", "x", va.alias("ma"), vb.alias("mb"), (va * va).alias("aa"), (vb * vb).alias("bb"), (va * vb).alias("ab"))
    for along, most in (("y", height), ("x", width)):
        parts = sums.withColumn("s", F.explode(sent)).withColumn(along, F.col(along) + F.col("s.o")).where(F.col(along).between(0, most - 1))
        sums = parts.groupBy(*image, "y", "x").agg(*(F.sum(F.col(c) * F.col("s.w")).alias(c) for c in ("ma", "mb", "aa", "bb", "ab")))
    c1, c2 = 0.01**2, 0.03**2
    ma, mb = F.col("ma"), F.col("mb")
    common = (2 * ma * mb + c1) * (2 * (F.col("ab") - ma * mb) + c2)
    whole = (ma * ma + mb * mb + c1) * (F.col("aa") - ma * ma + F.col("bb") - mb * mb + c2)
    return sums.groupBy(*image).agg(((F.sum(common / whole) + height * width - F.count("*")) / (height * width)).alias("ssim"))
