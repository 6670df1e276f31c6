"""Round trips and known files for sources, sinks and streams."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from gneiss.sources import arrays, ply, scenes
from gneiss.streaming import telemetry


def test_ply_round_trip(spark, tmp_path):
    ply.register(spark)
    df = spark.range(5000).select(F.col("id").cast("float").alias("x"), (F.col("id") * 2).cast("double").alias("y"), F.lit(3).cast("int").alias("cls"))
    df.write.format("ply").mode("append").save(f"{tmp_path}/cloud")
    back = spark.read.format("ply").load(f"{tmp_path}/cloud")
    assert back.columns == ["id", "x", "y", "cls"]
    assert spark.read.format("ply").load(f"file://{tmp_path}/cloud/part-*.ply").count() == 5000
    assert back.agg(F.count("*"), F.sum("x"), F.sum("y"), F.max("cls")).first()[:] == df.agg(F.count("*"), F.sum("x"), F.sum("y"), F.max("cls")).first()[:]


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "labels.npy", np.array([3, 1, 0, 2]))
    got = arrays.read_npy(spark, f"{tmp_path}/labels.npy").orderBy("id").collect()
    assert [(r["id"], r["value"]) for r in got] == [(0, 3.0), (1, 1.0), (2, 0.0), (3, 2.0)]
    masks = np.zeros((2, 3, 4), bool)
    masks[1, 2, 3] = True
    np.savez(tmp_path / "m.npz", a=masks, b=masks[1])
    got = {(r["key"], r["idx"]): (r["h"], r["w"], bytes(r["data"])) for r in arrays.read_mask_stacks(spark, f"{tmp_path}/m.npz").collect()}
    assert got == {("a", 0): (3, 4, b"\0\0"), ("a", 1): (3, 4, b"\0\x10"), ("b", 0): (3, 4, b"\0\x10")}


def test_scene_files(spark, tmp_path):
    (tmp_path / "points.txt").write_text("# comment\n7 1.0 2.0 3.5 10 20 30 0.5 1 2\n\n")
    assert scenes.read_points_text(spark, f"{tmp_path}/points.txt").first()[:] == (7, [1.0, 2.0, 3.5], [10, 20, 30], 0.5)
    (tmp_path / "cams.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n")
    assert scenes.read_cameras_text(spark, f"{tmp_path}/cams.txt").first()[:] == (1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0])
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 0.5 0 0 1 a.png\n1.5 2.5 9 3 4 -1\n2 1 0 0 0 0 0 0 1 b.png\n\n")
    got = scenes.read_images_text(spark, f"{tmp_path}/images.txt").orderBy("id").collect()
    assert [(r["name"], r["point_ids"]) for r in got] == [("a.png", [9, -1]), ("b.png", [])]
    (tmp_path / "t.json").write_text(json.dumps({"fl_x": 5.0, "w": 10, "frames": [{"file_path": "f0", "time": 0.0}, {"file_path": "f1", "time": 0.5, "w": 20}]}))
    got = scenes.read_transforms(spark, f"{tmp_path}/t.json").orderBy("at").collect()
    assert [(r["file_path"], r["fl_x"], r["w"]) for r in got] == [("f0", 5.0, 10), ("f1", 5.0, 20)]
    assert scenes.read_transforms(spark, f"{tmp_path}/t.json", end_frame=1).count() == 1
    (tmp_path / "d.json").write_text(json.dumps({"ids": ["a", "b", "c"], "train_ids": ["a"], "val_ids": ["c"]}))
    assert [r["part"] for r in scenes.read_dataset(spark, f"{tmp_path}/d.json").orderBy("at").collect()] == ["train", None, "val"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    live = telemetry.windowed_peaks(telemetry.telemetry(spark, f"{tmp_path}/in", 1), "1 hour", late="3650 days")
    query = live.writeStream.format("memory").queryName("gneiss_peaks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = events.groupBy(F.date_trunc("hour", "ts").alias("start"), (F.col("user_id") % 2).alias("gpu")).agg(F.count("*").alias("samples"), F.max("value").alias("peak"))
    got = spark.sql("SELECT cast(start AS timestamp) AS start, gpu, samples, peak FROM gneiss_peaks")
    assert got.exceptAll(want).count() == 0 and want.count() == got.count()


def test_stream_to_a_table_with_sessions(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/in")
    telemetry.run_to_table(telemetry.sessions(telemetry.telemetry(spark, f"{tmp_path}/in"), late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() > 0 and got.where("n < 1 OR end < start").count() == 0


def test_reports(spark, tmp_path):
    from gneiss.sources import reports

    df = spark.createDataFrame([("a_1", 0.123456, None), ("b", 2.0, "x|y")], "scene string, iou double, note string")
    reports.write_summary(df, f"{tmp_path}/s", ["scene", "iou"], ["scene"], ["iou"])
    assert spark.read.csv(f"{tmp_path}/s", header=True).orderBy("scene").collect()[0][:] == ("a_1", "0.1235")
    assert reports.markdown_table(df).splitlines()[2:] == ["| a_1 | 0.1235 |  |", "| b | 2.0000 | x\\|y |"]
    lines = [r["line"] for r in reports.tex_rows(df, ["scene"]).orderBy("at").collect()]
    assert lines == [r"a\_1 & 0.1235 &  \\", r"b & 2.0000 & x|y \\"]
    signs = spark.createDataFrame([(r"\ & % $ # _ { } ~ ^",)], "t string").select(reports.tex_text(F.col("t"))).first()[0]
    assert signs == r"\textbackslash{} \& \% \$ \# \_ \{ \} \textasciitilde{} \textasciicircum{}"
    fresh = spark.createDataFrame([("b", 3.0, None)], df.schema)
    assert {r["scene"]: r["iou"] for r in reports.upsert(df, fresh, ["scene"]).collect()} == {"a_1": 0.123456, "b": 3.0}
