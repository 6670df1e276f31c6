"""Streams with state against their batch twins, across restarts and replays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.streaming import frames, telemetry


@pytest.fixture(scope="module")
def keyed(spark):
    for k, v in frames.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in frames.STORE:
        spark.conf.unset(k)


def feed(df, path, i):
    df.coalesce(1).write.parquet(f"{path}/{i}")


def drained(spark, make, schema, path, work):
    """Run over what has arrived, as after a restart, and return all that was written."""
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path))
    telemetry.run_to_table(stream, f"{work}/out", f"{work}/ck")
    return spark.read.parquet(f"{work}/out")


def test_adjacent_frames_in_any_order(keyed, tmp_path):
    spark, rng = keyed, np.random.default_rng(3)
    maps = rng.integers(0, 4, (5, 30))
    rows = [("s", p, t, int(maps[t, p])) for t in range(5) for p in range(30)]
    schema = "scene string, pixel long, frame long, k long"
    split = lambda ts: spark.createDataFrame([r for r in rows if r[2] in ts], schema)
    feed(split([0, 3]), f"{tmp_path}/in", 0)
    feed(split([4]), f"{tmp_path}/in", 1)
    assert drained(spark, frames.adjacent_labels, schema, f"{tmp_path}/in", tmp_path).count() == 30
    feed(split([1, 2, 3, 4]), f"{tmp_path}/in", 2)  # 3 and 4 arrive again
    pairs = drained(spark, frames.adjacent_labels, schema, f"{tmp_path}/in", tmp_path)
    assert sorted(map(tuple, pairs.collect())) == sorted(("s", p, t, int(maps[t, p]), int(maps[t + 1, p])) for t in range(4) for p in range(30))
    got = {r["t"]: (r["tc"], r["ids"]) for r in frames.consistency(pairs).collect()}
    for t in range(4):
        a, b = maps[t], maps[t + 1]
        ids = [k for k in np.unique([a, b]) if k > 0]
        assert np.isclose(got[t][0], np.mean([((a == k) & (b == k)).sum() / ((a == k) | (b == k)).sum() for k in ids])) and got[t][1] == len(ids)


def test_running_means_after_a_restart(keyed, tmp_path):
    spark = keyed
    values = {"a": [3.0, None, 5.0, float("nan"), 1.0], "b": [2.0, 4.0]}
    rows = [(r, i, v) for r, vs in values.items() for i, v in enumerate(vs)]
    schema = "run string, step long, value double"
    part = lambda keep: spark.createDataFrame([r for r in rows if keep(r)], schema)
    feed(part(lambda r: r[1] in (1, 4)), f"{tmp_path}/in", 0)
    assert drained(spark, frames.running_means, schema, f"{tmp_path}/in", tmp_path).count() == 0
    feed(part(lambda r: r[1] in (0, 1, 2)), f"{tmp_path}/in", 1)
    feed(part(lambda r: r[1] == 3), f"{tmp_path}/in", 2)
    got = sorted(map(tuple, drained(spark, frames.running_means, schema, f"{tmp_path}/in", tmp_path).collect()))
    want = []
    for run, vs in values.items():
        mean = 0.0
        for i, v in enumerate(vs):
            mean = mean if v is None or v != v else 0.4 * v + 0.6 * mean
            want.append((run, i, mean))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_snapshots_and_a_replayed_batch(spark, tmp_path):
    schema = "scene string, step string, stage string, seconds double, at long"
    out = f"{tmp_path}/out"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    feed(batch(("x", "eval", "io", 1.0, 1), ("x", "eval", "io", 2.0, 2), ("x", "render", "io", 3.0, 1), ("y", "eval", "io", 4.0, 1)), f"{tmp_path}/in", 0)
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    frames.keep_snapshots(stream(), out, f"{tmp_path}/ck")
    second = batch(("x", "eval", "cut", 5.0, 3), (None, "eval", "io", 6.0, 3))
    feed(second, f"{tmp_path}/in", 1)
    frames.keep_snapshots(stream(), out, f"{tmp_path}/ck")
    rows = lambda: sorted(map(str, frames.snapshot(spark, out, "scene").collect()))
    once = rows()
    got = {tuple(r)[:4] for r in frames.snapshot(spark, out, "scene").collect()}
    assert got == {("x", "eval", "cut", 5.0), ("x", "render", "io", 3.0), ("y", "eval", "io", 4.0), (None, "eval", "io", 6.0)}
    frames.merge_batch(second, 1, out, "scene", "step", "at")  # replayed
    assert rows() == once
    # A batch that touches one scene writes that scene alone.
    assert {r[0] for r in spark.read.parquet(out).where(F.col("batch") == 1).select("scene").collect()} == {"x", None}
