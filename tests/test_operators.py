"""Known answers and brute-force twins for operators on small literal tables."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions.safe import iou, pearson
from gneiss.operators import affinity, clusters, evaluation, ledger
from gneiss.operators.proposals import greedy_union
from gneiss.operators.components import connected_components


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 8)] + [(50, 50), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(8)} | {50: 50}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("spread_", [1.0, 0.0])
def test_nearest_equals_brute_force(spark, spread_):
    rng = random.Random(5)
    rows = [(i, rng.random() * spread_, rng.gauss(0, 1) * spread_, rng.random() ** 4 * spread_) for i in range(60)] + [(99, 40.0, 0.0, 0.0), (98, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {}
    for r in affinity.nearest(points, 4).collect():
        got.setdefault(r.src, {})[r["rank"]] = r.dst
    whole = [r for r in rows if r[1] is not None]
    for a in whole:
        order = sorted((sum((p - q) ** 2 for p, q in zip(a[1:], b[1:], strict=True)), b[0]) for b in whole if b[0] != a[0])
        assert [got[a[0]][k] for k in (1, 2, 3, 4)] == [i for _, i in order[:4]]


def test_nearest_of_crowds_within_crowds(spark):
    """Half of the points in one place, a third in a small ball, the others spread; cells of more than 12 are split."""
    rng = random.Random(8)
    small = [tuple(0.3 + 1e-4 * rng.gauss(0, 1) for _ in range(3)) for _ in range(100)]
    rows = [(i, *p) for i, p in enumerate([(0.7, 0.7, 0.7)] * 150 + small + [tuple(rng.random() for _ in range(3)) for _ in range(50)])]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {}
    for r in affinity.nearest(points, 4, most=12).collect():
        got.setdefault(r.src, {})[r["rank"]] = r.dst
    for a in rows:
        order = sorted((sum((p - q) ** 2 for p, q in zip(a[1:], b[1:], strict=True)), b[0]) for b in rows if b[0] != a[0])
        assert [got[a[0]][k] for k in (1, 2, 3, 4)] == [i for _, i in order[:4]]


def test_nearest_with_fewer_points_than_k(spark):
    two = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert affinity.nearest(two, 5).count() == 2
    assert affinity.nearest(two.limit(1), 5).count() == 0


def test_greedy_union_takes_one_then_two(spark):
    pred, gt = [[1, 1, 2], [2, 3, 3]], [[1, 1, 1], [1, 0, 0]]
    rows = [(0, pred[y][x], bool(gt[y][x])) for y, x in itertools.product(range(2), range(3))]
    counts = evaluation.frame_counts(spark.createDataFrame(rows, "frame int, k int, gt boolean"))
    totals = evaluation.dense_counts(counts).groupBy("k").agg(F.sum("inter").alias("inter"), F.sum("pred").alias("pred"))
    assert [r["k"] for r in greedy_union(totals, F.lit(4)).orderBy("rank").collect()] == [1, 2]
    assert evaluation.union_iou(counts, [1, 2]).first()["iou"] == 1.0


def test_mean_accuracy_of_two_frames(spark):
    rows = [(0, 1, 1), (0, 1, 0), (0, 2, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1), (1, 0, 0), (1, 0, 0)]
    df = spark.createDataFrame(rows, "frame int, pred int, gt int")
    acc = {r["frame"]: r["acc"] for r in evaluation.mean_accuracy(df, "frame", F.col("pred") == 1, F.col("gt") == 1).collect()}
    assert acc == {0: 0.75, 1: 1.0}


def test_temporal_consistency_with_an_absent_id(spark):
    rows = [(0, 1, 1), (0, 2, 1), (0, 3, 2), (1, 1, 1), (1, 2, 3), (1, 3, 2)]
    got = evaluation.temporal_consistency(spark.createDataFrame(rows, "frame int, pixel int, k int")).first()
    assert got["ids"] == 3 and got["tc"] == pytest.approx((0.5 + 0 + 1) / 3)


def test_corner_pixels_count_twice(spark):
    rows = [(0, y, x, 1) for y in range(3) for x in range(3)]
    got = evaluation.image_stats(spark.createDataFrame(rows, "frame int, y int, x int, k int"), 3, 3).first()
    assert (got["area"], got["border"]) == (9, 12)


def test_correlation_without_variance_is_zero(spark):
    n, one = F.lit(4.0), F.lit(4.0)
    assert spark.range(1).select(pearson(n, one, F.lit(10.0), one, F.lit(30.0), F.lit(10.0))).first()[0] == 0.0
    assert spark.range(1).select(iou(F.lit(0), F.lit(0), F.lit(0))).first()[0] == 0.0


def test_static_fusion_truth_table(spark):
    rows = [(0.5, 0.1, 0.1), (0.5, 0.1, 9.0), (0.5, 9.0, 0.1), (0.5, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, ri double, rj double")
    got = [r[0] for r in df.select(affinity.static_fusion(F.col("a"), F.col("ri"), F.col("rj"), 1.0, 0.2)).collect()]
    assert got == pytest.approx([1.0, 0.6, 0.6, 0.5])


def test_symmetrise_sums_parallel_edges_then_takes_the_larger(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.25), (2, 1, 0.5), (3, 4, 0.0)], "src long, dst long, w double")
    assert sorted(map(tuple, affinity.symmetrise(edges).collect())) == [(1, 2, 0.75), (2, 1, 0.75)]


def test_groups_are_numbered_by_size_then_smallest_member(spark):
    pairs = spark.createDataFrame([(4, 5, 0.9), (5, 6, 0.9), (1, 2, 0.9), (1, 3, 0.1)], "a long, b long, s double")
    ids = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    got = {r["id"]: r["merged"] for r in clusters.merge_groups(pairs, ids, F.col("s") > 0.5).collect()}
    assert got == {4: 1, 5: 1, 6: 1, 1: 2, 2: 2, 3: 3, 7: 4}


def test_zip_sweep(spark):
    got = ledger.zip_sweep(spark, k=[14], knn=[20, 30, 40], b=[0.1]).orderBy("at").collect()
    assert [(r["k"], r["knn"]) for r in got] == [(14, 20), (14, 30), (14, 40)]
    with pytest.raises(ValueError):
        ledger.zip_sweep(spark, a=[1, 2], b=[1, 2, 3])


def test_names(spark):
    df = spark.createDataFrame([("  Cut Lemon-1! ", "-0.50", "v2"), ("é", "3.00", "v10"), ("", "100", "v1")], "s string, v string, n string")
    assert [tuple(r) for r in df.select(ledger.slug(F.col("s")), ledger.value_tag(F.col("v"))).collect()] == [("cut_lemon_1", "m0p5"), ("é", "3"), ("", "100")]
    assert [r[0] for r in df.orderBy(ledger.natural_key(F.col("n"))).select("n").collect()] == ["v1", "v2", "v10"]


def test_ancestors_have_no_limit_of_rows(spark):
    rows = [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 9), (6, None), (7, 8), (8, 7)]
    nodes = spark.createDataFrame(rows, "id long, parent long").withColumn("m", F.col("id").isin(1, 3))
    kept = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set(kept[0], "5")
    try:
        got = sorted(tuple(r) for r in ledger.ancestors(spark, nodes, F.col("m")).collect())
        near = sorted(tuple(r) for r in ledger.ancestors(spark, nodes, F.col("m"), 0).collect())
    finally:
        spark.conf.set(*kept)
    assert got == [(1, 1, 0), (2, 1, 1), (3, 3, 0), (4, 3, 1)] and near == [(1, 1, 0), (3, 3, 0)]
