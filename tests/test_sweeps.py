"""Cached results: what is computed, and when again."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import sweeps


def test_only_missing_and_changed_settings_are_computed(spark, tmp_path):
    done = []

    def run(rows, cuts, version="1"):
        inputs = spark.createDataFrame(rows, "scene string, v long")
        wanted = spark.createDataFrame([(s, c) for s in ("a", "b", "none") for c in cuts], "scene string, cut long")

        def compute(missing):
            done.append(sorted((r["scene"], r["cut"]) for r in missing.collect()))
            sums = missing.join(inputs, "scene", "left").groupBy("_key", "scene", "cut").agg(F.sum(F.when(F.col("v") <= F.col("cut"), F.col("v"))).alias("s"))
            return sums

        return sorted(map(tuple, sweeps.cached(f"{tmp_path}/t", wanted, inputs, "scene", compute, version).collect()), key=str)

    rows = [("a", 1), ("a", 2), ("b", 1), ("b", None)]
    first = run(rows, [1, 2])
    assert first == [("a", 1, 1), ("a", 2, 3), ("b", 1, 1), ("b", 2, 1), ("none", 1, None), ("none", 2, None)] and len(done) == 1
    # The same rows in another order are read.
    assert run(rows[::-1], [1, 2]) == first and len(done) == 1
    # A new setting is computed alone.
    assert len(run(rows, [1, 2, 9])) == 9 and done[-1] == [("a", 9), ("b", 9), ("none", 9)]
    # A changed input has its own scene's settings computed again.
    assert ("b", 2, 3) in run([*rows, ("b", 2)], [2]) and done[-1] == [("b", 2)]
    assert run(rows, [1, 2]) == first and len(done) == 3
    run(rows, [1], version="2")
    assert done[-1] == [("a", 1), ("b", 1), ("none", 1)]


def test_a_failed_run_leaves_no_results(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "scene string, v long")
    wanted = rows.select("scene")
    fail = lambda missing: missing.select("_key", F.raise_error(F.lit("lost")).cast("int").alias("s"))
    try:
        sweeps.cached(f"{tmp_path}/t", wanted, rows, "scene", fail)
        raise AssertionError("no error")
    except Exception as error:
        assert "lost" in str(error)
    assert sweeps.cached(f"{tmp_path}/t", wanted, rows, "scene", lambda m: m.select("_key", "scene")).collect() == [("a",)]
