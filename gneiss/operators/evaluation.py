"""Scoring of cluster label maps against masks.

All scores come from one table of counts per frame and cluster; it is the only
step that reads pixels, and its aggregate combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.safe import iou, pearson, ratio
from gneiss.operators.ordering import uniform


def frame_counts(pixels: DataFrame, frame: str = "frame", k: str = "k", gt: str = "gt") -> DataFrame:
    """``(frame, k, inter, pred, gt, pixels)``: counts of each cluster in each frame it occurs in."""
    counts = pixels.groupBy(frame, k).agg(F.count_if(gt).alias("inter"), F.count("*").alias("pred"))
    whole = Window.partitionBy(frame)  # one row a cluster and frame: small partitions
    return counts.select(frame, k, "inter", "pred", F.sum("inter").over(whole).alias("gt"), F.sum("pred").over(whole).alias("pixels"))


def dense_counts(counts: DataFrame, frame: str = "frame", k: str = "k") -> DataFrame:
    """Adds zero rows for clusters that a frame does not show."""
    frames = counts.groupBy(frame).agg(F.first("gt").alias("gt"), F.first("pixels").alias("pixels"))
    grid = frames.crossJoin(F.broadcast(counts.select(k).distinct()))  # frames x clusters is the result's own size
    return grid.join(counts.select(frame, k, "inter", "pred"), [frame, k], "left").select(
        frame, k, F.coalesce("inter", F.lit(0)).alias("inter"), F.coalesce("pred", F.lit(0)).alias("pred"), "gt", "pixels"
    )


def pooled_iou(counts: DataFrame, k: str = "k") -> DataFrame:
    """IoU of each cluster with counts summed over all frames before dividing."""
    return dense_counts(counts).groupBy(k).agg(F.sum("inter").alias("inter"), F.sum("pred").alias("pred"), F.sum("gt").alias("gt")).withColumn("iou", iou(F.col("inter"), F.col("pred"), F.col("gt")))


def frame_mean_iou(counts: DataFrame, k: str = "k") -> DataFrame:
    """Mean over frames of each cluster's IoU and accuracy in the frame."""
    i, p, g, n = (F.col(c) for c in ("inter", "pred", "gt", "pixels"))
    return dense_counts(counts).groupBy(k).agg(F.avg(iou(i, p, g)).alias("iou"), F.avg(ratio(n - p - g + 2 * i, n)).alias("acc"), F.count("*").alias("frames"))


def best(scores: DataFrame, score: str, key: str = "k") -> DataFrame:
    """The row with the highest score, the lowest key on ties."""
    return scores.orderBy(F.col(score).desc(), key).limit(1)


def union_iou(counts: DataFrame, selected: list[int], frame: str = "frame", k: str = "k") -> DataFrame:
    """IoU in each frame of the union of the selected clusters."""
    chosen = F.col(k).isin(selected)
    zero = F.lit(0)
    per_frame = counts.groupBy(frame).agg(
        F.sum(F.when(chosen, F.col("inter")).otherwise(zero)).alias("inter"), F.sum(F.when(chosen, F.col("pred")).otherwise(zero)).alias("pred"),
        F.max("gt").alias("gt"), F.max("pixels").alias("pixels"),
    )
    return per_frame.withColumn("iou", iou(F.col("inter"), F.col("pred"), F.col("gt")))


def mean_accuracy(pixels: DataFrame, frame: str, pred: Column, gt: Column) -> DataFrame:
    """Per frame, the share of pixels where the binary prediction equals the mask."""
    return pixels.groupBy(frame).agg(F.avg((pred == gt).cast("double")).alias("acc"), F.count("*").alias("pixels"))


def temporal_consistency(rasters: DataFrame, frame: str = "frame", pixel: str = "pixel", k: str = "k") -> DataFrame:
    """Mean IoU of the ids of each two adjacent frames, over pixels in both.

    The frames are ranked once; pixels of a frame meet those of the next by an
    equi-join on pixel and rank.  A cluster absent from both frames is no id of
    the pair; a pair without ids gives no row.
    """
    rank = F.row_number().over(Window.orderBy("of"))
    order = rasters.select(F.col(frame).alias("of")).distinct().select("of", rank.alias("rank"))  # one row a frame
    ranked = rasters.join(F.broadcast(order) if order.limit(100_001).count() <= 100_000 else order, F.col(frame) == F.col("of"))
    a = ranked.select(F.col("rank").alias("t"), F.col(pixel).alias("p"), F.col(k).alias("a"))
    b = ranked.select((F.col("rank") - 1).alias("t"), F.col(pixel).alias("p"), F.col(k).alias("b"))
    joint = a.join(b, ["t", "p"]).groupBy("t", "a", "b").agg(F.count("*").alias("n"))
    ids = joint.select("t", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(True).alias("first")), F.struct(F.col("b").alias("id"), F.lit(False).alias("first")))).alias("s"), "n", "a", "b")
    per_id = ids.where("s.id > 0").groupBy("t", F.col("s.id").alias("id")).agg(
        F.sum(F.when(F.col("s.first") & (F.col("a") == F.col("b")), F.col("n")).otherwise(0)).alias("inter"),
        F.sum(F.when(F.col("s.first"), F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(~F.col("s.first"), F.col("n")).otherwise(0)).alias("nb"),
    )
    return per_id.groupBy("t").agg(F.avg(iou(F.col("inter"), F.col("na"), F.col("nb"))).alias("tc"), F.count("*").alias("ids"))


def image_stats(pixels: DataFrame, height: int, width: int, k: str = "k") -> DataFrame:
    """Area and border contacts of each cluster; a corner touches two borders."""
    touch = sum(((F.col(c) == v).cast("int") for c, v in (("y", 0), ("y", height - 1), ("x", 0), ("x", width - 1))), F.lit(0))
    return pixels.groupBy(k).agg(F.count("*").alias("area"), F.sum(touch).alias("border"), F.countDistinct("frame").alias("frames"))


def visibility_correlation(counts: DataFrame, k: str = "k") -> DataFrame:
    """Correlation over frames of the visible areas of each two clusters.

    The join is over the count table, frames x clusters: its result has one row
    for two clusters and a frame, never one for two pixels.
    """
    c = dense_counts(counts)
    a, b = c.select("frame", F.col(k).alias("a"), F.col("pred").cast("double").alias("va")), c.select("frame", F.col(k).alias("b"), F.col("pred").cast("double").alias("vb"))
    sums = a.join(b, "frame").where("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum("va").alias("sa"), F.sum("vb").alias("sb"), F.sum(F.col("va") * F.col("va")).alias("saa"),
        F.sum(F.col("vb") * F.col("vb")).alias("sbb"), F.sum(F.col("va") * F.col("vb")).alias("sab"),
    )
    return sums.select("a", "b", pearson(*(F.col(x) for x in ("n", "sa", "sb", "saa", "sbb", "sab"))).alias("corr"))


def confusion(pixels: DataFrame, selected: list[int]) -> DataFrame:
    """Pixels of each frame by TP, FP, FN or TN for the union of selected clusters."""
    pred = F.col("k").isin(selected)
    kind = F.when(pred & F.col("gt"), "TP").when(pred, "FP").when(F.col("gt"), "FN").otherwise("TN")
    return pixels.groupBy("frame", kind.alias("kind")).agg(F.count("*").alias("n"))


def sampled_keys(rows: DataFrame, key: str, expected: int) -> DataFrame:
    """Each different key with the same chance, so that about ``expected`` are drawn; reruns draw the same."""
    keys = rows.select(key).distinct()
    n = keys.agg(F.count("*").alias("_n"))
    return keys.crossJoin(F.broadcast(n)).where(uniform(F.col(key)) < F.lit(float(expected)) / F.col("_n")).select(key)  # one row
