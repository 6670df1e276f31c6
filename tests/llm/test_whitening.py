"""Whitening against numpy's decomposition of the covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gneiss.llm import whitening


def brute(vectors, wanted=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array(x, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = [i for i in range(min(wanted, len(values))) if values[i] > 1e-20 * values[0]]
    return n, deviation, centred @ vectors[:, some] / np.sqrt(values[some]), values[some] / values.sum()


def check(spark, vectors, kind="array<double>", tolerance=1e-7):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], f"vec_id long, embedding {kind}").repartition(3)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    n, deviation, white, explained = brute(vectors)
    assert len(got) == n * len(explained)
    for k in range(len(explained)):
        column = np.array([got[i, k + 1]["whitened"] for i in range(n)])
        sign = np.sign(column @ white[:, k])
        assert np.abs(sign * column - white[:, k]).max() < tolerance
        assert got[0, k + 1]["explained"] == pytest.approx(explained[k], rel=1e-9)
    for i in range(n):
        assert got[i, 1]["deviation"] == deviation[i] and got[i, 1]["n"] == n and got[i, 1]["identity_error"] < 1e-9


def test_equals_the_decomposition(spark):
    rng = np.random.default_rng(1)
    check(spark, (rng.standard_normal((200, 20)) * np.linspace(3, 0.1, 20)).tolist())
    check(spark, (rng.standard_normal((300, 64)) / 8).astype(np.float32).tolist(), "array<float>")


def test_strongly_graded_and_lost_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 12)) * np.logspace(3, -1, 12)
    x[:, 5] = 0.25
    x[:, 7] = x[:, 6]
    check(spark, x.tolist(), tolerance=1e-6)


def test_equal_eigenvalues_are_all_found(spark):
    rows = [[s * float(i == k) for i in range(10)] for k in range(10) for s in (1.0, -1.0)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 20 * 8 and max(r["identity_error"] for r in got) < 1e-9 and all(r["explained"] == pytest.approx(0.1) for r in got)


def test_few_rows_have_few_components(spark):
    check(spark, [[0.0, 1.0, 2.0], [1.0, 1.0, 2.5], [0.5, 1.0, -2.0]])
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_awkward_rows(spark):
    good = [[0.1 * i, math.sin(i), float(i % 3)] for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, math.nan, 2.0]), (103, [1.0, math.inf, 0.0]), (104, [-math.inf, 0.0, 0.0])]
    rows = [(i, v, 9.0, "x") for i, v in enumerate(good)] + [(i, v, 1.0, "y") for i, v in bad] + [(None, [5.0, 1.0], 0.0, "z"), (0, good[0], 0.0, "again")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, id string")).collect()
    n, deviation, _, _ = brute([*good, [5.0, 1.0, 0.0], good[0]])
    assert got[0]["n"] == n == 32 and len(got) == 32 * 3 and sum(r["vec_id"] == 0 for r in got) == 6
    assert {r["deviation"] for r in got if r["vec_id"] is None} == {deviation[30]}
    assert {r["vec_id"] for r in got} == {None, *range(30)}


def test_left_vectors_stay_orthogonal():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 30)) * np.logspace(0, -6, 30)
    lanczos = whitening.Bidiagonal(lambda w: (float((x @ w) @ (x @ w)), x.T @ (x @ w)), 30)
    for _ in range(30):
        lanczos.step()
    u = x @ lanczos.w.T
    assert np.abs(lanczos.v @ lanczos.v.T - np.eye(30)).max() < 1e-12
    values = lanczos.singular()[0]
    assert values[:12] == pytest.approx(np.linalg.svd(x)[1][:12].tolist(), rel=1e-9)
    assert np.abs(u[:, :12].T @ u[:, :12] - np.eye(12)).max() < 1e-6
