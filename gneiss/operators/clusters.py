"""Aggregates, merging and ordering of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.safe import dot, norm
from gneiss.operators.components import connected_components


def cluster_means(points: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, pos, mean, std, n)`` of each component of a vector column; std is of the population."""
    parts = points.select(key, F.posexplode(vector).alias("pos", "v"))
    return parts.groupBy(key, "pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))


def cluster_vectors(points: DataFrame, key: str, vector: str) -> DataFrame:
    """Each cluster's mean vector, put together again in order."""
    means = cluster_means(points, key, vector)
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mean"), F.max("n").alias("n"))


def pairwise_cosine(vectors: DataFrame, key: str, vector: str, scalar_centred: bool = False) -> DataFrame:
    """``(a, b, cosine)`` of each two clusters, a < b; the table has one row a cluster."""
    v = F.col(vector)
    if scalar_centred:
        mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)
        vectors = vectors.withColumn("_mean", mean).withColumn(vector, F.transform(v, lambda x: x - F.col("_mean"))).drop("_mean")
    a = vectors.select(F.col(key).alias("a"), F.col(vector).alias("va"))
    b = vectors.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", (dot(F.col("va"), F.col("vb")) / F.greatest(norm(F.col("va")) * norm(F.col("vb")), F.lit(1e-12))).alias("cosine"))


def merge_groups(pairs: DataFrame, ids: DataFrame, above: Column, key: str = "id") -> DataFrame:
    """``(id, merged)``: clusters joined by pairs for which ``above`` holds get one
    new id; groups are numbered from 1 by size, then by their smallest member."""
    linked = connected_components(pairs.where(above), "a", "b")
    grouped = ids.select(F.col(key).alias("id")).join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("root"))
    order = Window.orderBy(F.col("members").desc(), "root")
    ranks = grouped.groupBy("root").agg(F.count("*").alias("members")).select("root", F.row_number().over(order).cast("long").alias("merged"))
    return grouped.join(ranks, "root").select("id", "merged")
