"""Selections, samples, losses over pairs, running statistics and first values of primitives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.safe import dot, norm, ratio
from gneiss.operators.affinity import nearest
from gneiss.operators.ordering import uniform


def shape_match(h: Column, w: Column, of_h: Column, of_w: Column, transpose: bool = True) -> Column:
    """``direct``, ``transposed`` where that is accepted, or null."""
    turned = (h == of_w) & (w == of_h) if transpose else F.lit(False)
    return F.when((h == of_h) & (w == of_w), "direct").when(turned, "transposed")


def bernoulli(rows: DataFrame, rate: Column | float, *keys: Column) -> DataFrame:
    """Rows drawn each with a chance of ``rate``; reruns draw the same."""
    return rows.where(uniform(*keys) < (F.lit(rate) if isinstance(rate, float) else rate))


def subsample(rows: DataFrame, n: int, *keys: Column) -> DataFrame:
    """``n`` rows without replacement: those of the smallest variates, which few tasks send on."""
    return rows.withColumn("_u", uniform(*keys)).orderBy("_u", *keys).limit(n).drop("_u")


def growth_masks(gradient: Column, scale: Column, least: float, dense: float, extent: float) -> Column:
    """``clone`` for small primitives with a steep gradient, ``split`` for large ones, else null."""
    large = F.array_max(scale) > dense * extent
    return F.when((gradient >= least) & ~large, "clone").when((gradient >= least) & large, "split")


def split_offsets(scale: Column, *keys: Column) -> list[Column]:
    """Repeatable normal draws with the scale of each axis, by Box and Muller's transform."""
    draw = lambda i, j: uniform(*keys, F.lit(i), F.lit(j))
    return [F.get(scale, i) * F.sqrt(-2 * F.log(1 - draw(i, 0))) * F.cos(2 * math.pi * draw(i, 1)) for i in range(3)]


def pair_features(sampled: DataFrame, frame: str, key: str, mask: str, vector: str) -> DataFrame:
    """``(frame, a, b, same, cosine)`` of each two sampled pixels of a frame, a < b, and of each with itself.

    ``same`` holds where a mask has both.  The sample bounds the pairs of a frame:
    its size is a parameter of the sampling.
    """
    points = sampled.groupBy(frame, key).agg(F.collect_set(mask).alias("masks"), F.any_value(vector).alias("v"))
    unit = points.withColumn("n", F.greatest(norm(F.col("v")), F.lit(1e-12)))
    side = lambda s: unit.select(frame, F.col(key).alias(s), F.col("masks").alias(f"m_{s}"), F.col("v").alias(f"v_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = side("a").join(side("b"), frame).where("a <= b")
    return pairs.select(frame, "a", "b", F.arrays_overlap("m_a", "m_b").alias("same"), (dot(F.col("v_a"), F.col("v_b")) / (F.col("n_a") * F.col("n_b"))).alias("cosine"))


def pair_losses(pairs: DataFrame, frame: str, positive: float = 0.75, negative: float = 0.5) -> DataFrame:
    """One row a frame with pairs: losses over pairs of its pixels that share a mask, and over those that share none.

    Pairs that share one lose their cosine's opposite, the others what the
    cosine is above 0.  ``hard`` is the mean over pairs beyond the threshold
    (cosine below ``positive``, above ``negative``).  ``all`` divides the sum
    over all such pairs by the pairs (a, b), a < b, whose b has such a pair at
    all, with any pixel or with itself; ``soft`` is the same over pixels b that
    have such a pair beyond the threshold.  0 where there is none.
    """
    both = pairs.unionByName(pairs.where("a <> b").select(frame, F.col("b").alias("a"), F.col("a").alias("b"), "same", "cosine"))
    c, same = F.col("cosine"), F.col("same")
    per = both.groupBy(F.col(frame).alias("_frame"), F.col("b").alias("of")).agg(
        F.bool_or(same).alias("p"), F.bool_or(same & (c < positive)).alias("hp"), F.bool_or(~same).alias("n"), F.bool_or(~same & (c > negative)).alias("hn")
    )
    open_ = pairs.where("a < b").join(per, (F.col("b") == F.col("of")) & (F.col(frame) == F.col("_frame")))
    loss_p, loss_n = -c, F.greatest(c, F.lit(0.0))
    total = lambda where, loss: F.sum(F.when(where, loss).otherwise(0.0))
    n = lambda where: F.count_if(where)
    return open_.groupBy(frame).agg(
        ratio(total(same & (c < positive), loss_p), n(same & (c < positive))).alias("hard_positive"),
        ratio(total(same & F.col("p"), loss_p), n(F.col("p"))).alias("all_positive"),
        ratio(total(same & F.col("hp"), loss_p), n(F.col("hp"))).alias("soft_positive"),
        ratio(total(~same & (c > negative), loss_n), n(~same & (c > negative))).alias("hard_negative"),
        ratio(total(~same & F.col("n"), loss_n), n(F.col("n"))).alias("all_negative"),
        ratio(total(~same & F.col("hn"), loss_n), n(F.col("hn"))).alias("soft_negative"),
    )


def smoothed(rows: DataFrame, key: str, order: list[str], value: str, share: float = 0.4) -> DataFrame:
    """``(key, n, ema)``: each key's exponential mean from 0 on, ``share`` of a new value and the rest of the old.

    What lies further back than the last values whose weights matter to a
    double is below its rounding, so a key's history is never gathered.
    """
    deep = math.ceil(-math.log(2.0**-60) / -math.log(1 - share))
    back = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    last = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= deep)
    ema = last.groupBy(key).agg(F.sum(share * F.pow(F.lit(1 - share), F.col("_back") - 1) * F.col(value)).alias("ema"))
    return rows.groupBy(key).agg(F.count("*").alias("n")).join(ema, key)


def first_primitives(points: DataFrame, opacity: float = 0.1) -> DataFrame:
    """``(id, scale, w, x, y, z, opacity)`` of new primitives: the logarithm of the root mean
    square distance to the three nearest points, no rotation, the logit of an opacity."""
    d2 = nearest(points, 3).groupBy("src").agg(F.avg("d2").alias("d2"))
    rows = d2.select(F.col("src").alias("id"), F.log(F.sqrt(F.greatest("d2", F.lit(1e-7)))).alias("scale"))
    return rows.select("*", F.lit(1.0).alias("w"), *(F.lit(0.0).alias(c) for c in "xyz"), F.lit(math.log(opacity / (1 - opacity))).alias("opacity"))


def token_after(text: Column, key: str) -> Column:
    """The token behind the first one that equals ``key``; null where there is none."""
    tokens = F.filter(F.split(text, "\\s+"), lambda t: t != "")
    at = F.array_position(tokens, key)
    return F.when(at > 0, F.get(tokens, at.cast("int")))


def frame_defaults(n: Column, ids: Column, scores: Column, boxes: Column) -> list[Column]:
    """Ids 0 to n - 1, scores and boxes of zeros where a frame's own are missing."""
    count = F.greatest(n, F.lit(0)).cast("int")
    own = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    zeros = F.array_repeat(F.lit(0.0), count)
    return [F.coalesce(ids, own), F.coalesce(scores, zeros), F.coalesce(boxes, F.array_repeat(F.array(*[F.lit(0.0)] * 4), count))]
