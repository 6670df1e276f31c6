"""Readers of binary reconstructions, bundles, reports and run folders on small known files."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import numpy as np
from pyspark.sql import functions as F

from gneiss.sources import arrays, clouds, reconstructions, records


def test_binary_reconstructions(spark, tmp_path):
    points = struct.pack("<Q", 2) + b"".join(struct.pack("<Q3d3BdQ", i, 1.0 * i, 2.0, 3.0, 10, 20, 30, 0.5, 2) + struct.pack("<4i", 1, 2, 3, 4) for i in (7, 8))
    (tmp_path / "points.bin").write_bytes(points)
    got = reconstructions.read_points(spark, f"{tmp_path}/points.bin").orderBy("id").collect()
    assert [r[:] for r in got] == [(7, [7.0, 2.0, 3.0], [10, 20, 30], 0.5), (8, [8.0, 2.0, 3.0], [10, 20, 30], 0.5)]
    cameras = struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 500, 501, 320, 240) + struct.pack("<iiQQ12d", 2, 10, 64, 48, *range(12))
    (tmp_path / "cameras.bin").write_bytes(cameras)
    got = reconstructions.read_cameras(spark, f"{tmp_path}/cameras.bin").orderBy("id").collect()
    assert [r[:] for r in got] == [(1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0]), (2, "THIN_PRISM_FISHEYE", 64, 48, [float(i) for i in range(12)])]
    image = lambda i, name, seen: struct.pack("<i7di", i, 1, 0, 0, 0, 0.5, 0, 0, 1) + name + b"\0" + struct.pack("<Q", len(seen)) + b"".join(struct.pack("<ddq", *s) for s in seen)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 2) + image(3, b"a.png", [(1.5, 2.5, 9), (3.0, 4.0, -1)]) + image(4, "é.png".encode(), []))
    images = reconstructions.read_images(spark, f"{tmp_path}/images.bin")
    assert [r[:] for r in images.orderBy("id").collect()] == [(3, [1.0, 0.0, 0.0, 0.0], [0.5, 0.0, 0.0], 1, "a.png", [[1.5, 2.5], [3.0, 4.0]], [9, -1]), (4, [1.0, 0.0, 0.0, 0.0], [0.5, 0.0, 0.0], 1, "é.png", [], [])]
    posed = reconstructions.posed_cameras(images, reconstructions.read_cameras(spark, f"{tmp_path}/cameras.bin"))
    assert [(r["name"], r["width"]) for r in posed.orderBy("id").collect()] == [("a.png", 640), ("é.png", 640)]
    grid = np.arange(12, dtype="<f4").reshape((3, 2, 2), order="F")  # width, height, channels
    (tmp_path / "depth.bin").write_bytes(b"3&2&2&" + grid.tobytes(order="F"))
    got = {r["y"]: r["values"] for r in reconstructions.read_dense(spark, f"{tmp_path}/depth.bin").collect()}
    assert got == {y: [[float(grid[x, y, c]) for c in range(2)] for x in range(3)] for y in range(2)}
    (tmp_path / "none.bin").write_bytes(struct.pack("<Q", 0))
    assert reconstructions.read_points(spark, f"{tmp_path}/none.bin").count() == 0


def test_stacks_in_a_bundle(spark, tmp_path):
    stack = io.BytesIO()
    np.savez(stack, a=np.eye(2, dtype=bool))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/one.npz", stack.getvalue())
        z.writestr("x/other.npz", stack.getvalue())
        z.writestr("notes.txt", "no")
    got = arrays.read_bundled_stacks(spark, f"{tmp_path}/b.zip", r"one\.npz$").collect()
    assert [(r["path"].rsplit("!")[1], r["key"], r["h"], r["w"], bytes(r["data"])) for r in got] == [("x/one.npz", "a", 2, 2, b"\x90")]
    assert arrays.read_bundled_stacks(spark, f"{tmp_path}/b.zip").count() == 2


def test_results_and_reports_in_folders(spark, tmp_path):
    for run, value in (("r1", 0.5), ("deep/r2", 0.75)):
        (tmp_path / run).mkdir(parents=True)
        (tmp_path / run / "miou.json").write_text(json.dumps({"mIoU": value}))
    got = records.read_results(spark, "mIoU double, macc double", f"{tmp_path}/*/miou.json", f"{tmp_path}/*/*/miou.json", f"{tmp_path}/r1/*.json")
    assert sorted(r[1:] for r in got.collect()) == [("r1", 0.5, None), ("r2", 0.75, None)]
    (tmp_path / "run_tau20.log").write_text("x\n[done]\n")
    (tmp_path / "run_tau30.log").write_text("Traceback\n")
    (tmp_path / "other.log").write_text("[done]")
    got = records.log_status(records.read_texts(spark, f"{tmp_path}/*.log"))
    assert sorted(r[:] for r in got.collect()) == [("20", 1, 0), ("30", 0, 1)]


def test_sections_are_replaced_or_added(spark):
    text = "# R\n\n## Timings - a\n\nold\n\n## B\nkept\n"
    df = spark.createDataFrame([(text,), ("# R\n\n\n",), (None,)], "t string")
    got = [r[0] for r in df.select(records.with_section(F.col("t"), F.lit("Timings - a"), F.lit("new\n\n"))).collect()]
    new = "## Timings - a\n\nnew\n"
    assert got == [f"# R\n\n{new}\n## B\nkept\n", f"# R\n\n{new}", new]


def test_annotated_and_segmented_points(spark):
    points = spark.createDataFrame([(i, 0.1, 0.2, 0.3, 0.9, 200) for i in range(3)], "id long, f_dc_0 float, f_dc_1 float, f_dc_2 float, f_rest_0 float, red int")
    marked = clouds.annotated(points, spark.createDataFrame([(0, 1), (1, 2)], "id long, label int"))
    assert {r["id"]: r["cls"] for r in marked.collect()} == {0: 1, 1: 2, 2: -1}
    palette = [(0, 0, 0), (255, 0, 51)]
    rows = {r["id"]: r for r in clouds.segmented(marked, palette).collect()}
    assert (rows[0]["red"], rows[0]["green"], rows[0]["blue"], rows[0]["f_rest_0"]) == (255, 0, 51, 0.0) and abs(rows[0]["f_dc_0"] - 0.5 / clouds.CONSTANT) < 1e-6
    kept = clouds.segmented(marked, palette, keep_harmonics=True).first()
    assert abs(kept["f_dc_0"] - 0.1) < 1e-6 and kept["f_rest_0"] > 0.8
    assert clouds.segmented(marked, palette, minimal=["id"]).columns == ["id", "cls", "red", "green", "blue"]
    colours = clouds.unit_colours(spark.createDataFrame([(255, 0, 51)], "red int, green int, blue int")).first()
    assert colours[:] == (1.0, 0.0, 0.2)


def test_provenance_of_what_is_said_and_what_is_not(spark):
    runs = spark.createDataFrame([("d", "f", v, "s", r) for v, r in (("full", "a"), ("full", "b_nogeo"), ("no_geo", "c"))], "dataset string, family string, variant string, scene string, run string")
    text = "Resolution parameter: **1.5**\nModularity Q: **0.7**\n## Parameters\n| param | value |\n|---|---|\n| power | 2 |\n| use_geometry | False |\n| gamma | |\n## Other\n| edges | 1 |\n"
    reports = spark.createDataFrame([("a", text), ("c", "nothing")], "run string, text string")
    timings = spark.createDataFrame([("a", '{"device": "x", "render": {"render_main": 0.5, "io": 2}, "eval_total_s": 1}'), ("c", "broken")], "run string, text string")
    got = {r["run"]: r for r in records.provenance(runs, reports, timings, ["power", "gamma", "use_geometry"]).collect()}
    assert got["a"]["params"] == "power=2; use_geometry=False" and got["a"]["graph"] == "--" and got["a"]["timing"] == "render.render_main=0.500s; eval_total_s=1.000s"
    assert (got["a"]["device"], got["a"]["n_valid"], got["a"]["resolution"], got["a"]["communities"], got["a"]["modularity_q"]) == ("x", "--", "1.5", "--", "0.7")
    assert got["b_nogeo"]["params"] == got["c"]["params"] == "power=--; gamma=--; use_geometry=False" and got["c"]["timing"] == "--"
    paths = spark.createDataFrame([("o/r/objectness_x/cluster_ids_train",), ("o/r/cluster_ids_train",), ("o/r",)], "p string")
    assert {r[0] for r in paths.select(records.base_run(paths.p)).collect()} == {"o/r"}
