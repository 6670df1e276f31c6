"""Files written by the sinks, read back; pixels of images."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.sources import arrays, images, members
from gneiss.sources.clouds import id_map_rows


@pytest.fixture(scope="module")
def stacks(spark):
    members.register(spark)
    rng = np.random.default_rng(1)
    rows = [(f"s{p}.npz", key, i, 4, 6, bytearray(np.packbits(rng.random((4, 6)) < 0.5).tobytes())) for p in range(3) for key in ("left", "right") for i in range(3)]
    return spark.createDataFrame(rows, "path string, key string, idx int, h int, w int, data binary").repartition(5)


def as_set(df):
    return {(r["path"].rsplit("/", 1)[-1], r["key"], r["idx"], r["h"], r["w"], bytes(r["data"])) for r in df.collect()}


def test_mask_stacks_come_back(spark, stacks, tmp_path):
    members.write_mask_stacks(stacks, f"file://{tmp_path}/npz")
    assert as_set(arrays.read_mask_stacks(spark, f"file://{tmp_path}/npz")) == as_set(stacks)
    members.write_mask_stacks(stacks.where("idx = 0"), f"file://{tmp_path}/npz")  # in place of those that were there
    assert as_set(arrays.read_mask_stacks(spark, f"file://{tmp_path}/npz")) == as_set(stacks.where("idx = 0"))
    members.write_bundled_stacks(stacks, f"file://{tmp_path}/zip")
    got = as_set(arrays.read_bundled_stacks(spark, f"file://{tmp_path}/zip"))
    assert {(p.split("!")[1], *rest) for p, *rest in got} == as_set(stacks)
    assert sorted(p.name for p in (tmp_path / "npz").iterdir()) == ["s0.npz", "s1.npz", "s2.npz"]


def test_a_failed_job_leaves_no_file(spark, stacks, tmp_path):
    bad = stacks.union(stacks.limit(1).withColumn("h", F.lit(3)))
    with pytest.raises(Exception, match="shapes"):
        members.write_mask_stacks(bad, f"file://{tmp_path}/bad")
    assert not [p for p in tmp_path.rglob("*") if p.suffix == ".npz"]


def test_a_second_attempt_takes_the_place_of_the_first(tmp_path):
    writer = members.MemberWriter(f"file://{tmp_path}/w", False)
    lost = writer.write(iter([{"file": "a.bin", "member": "", "content": b"half"}]))
    kept = writer.write(iter([{"file": "a.bin", "member": "", "content": b"whole"}]))
    writer.commit([kept])
    writer.abort([lost])
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "w").iterdir()] == [("a.bin", b"whole")]
    with pytest.raises(ValueError):
        writer.write(iter([{"file": "b", "member": "", "content": b"1"}, {"file": "b", "member": "", "content": b"2"}]))


def test_labels_in_parts_are_one_array(spark, tmp_path):
    members.register(spark)
    df = spark.range(1000).select((999 - F.col("id")).alias("id"), (F.col("id") % 17).alias("label")).repartition(4)
    members.write_npy(df, f"file://{tmp_path}/npy", "label", ["id"], part_rows=300)
    parts = sorted((tmp_path / "npy").iterdir())
    assert [p.name for p in parts] == [f"part-0000{i}.npy" for i in range(4)]
    assert np.concatenate([np.load(p) for p in parts]).tolist() == [(999 - i) % 17 for i in range(1000)]
    assert arrays.read_npy(spark, f"file://{tmp_path}/npy").count() == 1000


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    members.register(spark)
    rng = np.random.default_rng(2)
    out = {"m_007": rng.integers(0, 4, (6, 8)).astype(np.uint8), "m_012": rng.integers(0, 256, (4, 5, 3)).astype(np.uint8)}
    folder = f"file://{tmp_path_factory.mktemp('png')}"
    members.write_files(spark.createDataFrame([(f"{n}.png", bytearray(members.png(p))) for n, p in out.items()], "file string, content binary"), folder)
    return folder, out


def test_id_maps_are_images(spark, tmp_path):
    members.register(spark)
    pixels = spark.createDataFrame([("f1", 0, 0, 5), ("f1", 2, 3, 255), ("f2", 1, 1, 7)], "image string, y int, x int, k int")
    members.write_id_maps(id_map_rows(pixels, ["image"], 3, 4), f"file://{tmp_path}/ids")
    got = images.read_label_maps(spark, f"file://{tmp_path}/ids")
    assert {(r["frame"], r["y"], r["x"], r["k"]) for r in images.label_pixels(got).collect()} == {(1, 0, 0, 5), (1, 2, 3, 255), (2, 1, 1, 7)}
    assert {(r["h"], r["w"]) for r in got.collect()} == {(3, 4)}


def test_label_maps_take_the_first_channel(spark, pictures):
    folder, out = pictures
    got = {r["frame"]: np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"]) for r in images.read_label_maps(spark, folder).collect()}
    assert np.array_equal(got[7], out["m_007"]) and np.array_equal(got[12], out["m_012"][..., 0])


def test_presence_is_resampled_and_missing_frames_are_background(spark, pictures):
    folder, out = pictures
    frames = spark.createDataFrame([(7, 3, 4), (12, 4, 5), (99, 2, 2)], "frame int, h int, w int")
    got = {r["frame"]: np.unpackbits(np.frombuffer(r["data"], np.uint8), count=r["h"] * r["w"]).reshape(r["h"], r["w"]) for r in images.read_presence(spark, folder, frames).collect()}
    assert np.array_equal(got[7], out["m_007"][::2, ::2] > 0) and not got[99].any()
    assert np.array_equal(got[12], (out["m_012"] @ np.array(images.GREY) + 0x8000) >> 16 > 0)


def test_images_at_the_sizes_of_the_rule(spark, pictures):
    folder, out = pictures
    got = {r["frame"]: r for r in images.read_images(spark, folder, 2).collect()}
    assert (got[7]["h"], got[7]["w"]) == (3, 4) and (got[12]["h"], got[12]["w"], got[12]["channels"]) == (2, 2, 3)
    same = {r["frame"]: r for r in images.read_images(spark, folder, 1).collect()}
    assert np.array_equal(np.frombuffer(same[12]["data"], np.uint8).reshape(4, 5, 3), out["m_012"])
    assert images.target_size(3200, 900, -1) == (1600, 450) and images.target_size(800, 600, -1) == (800, 600) and images.target_size(800, 600, 400, 2) == (200, 150)
    assert images.target_size(1001, 501, 4) == (round(1001 / 4), round(501 / 4))


def test_resampling_keeps_flat_and_even_images():
    flat = np.full((9, 7, 3), 83, np.uint8)
    assert (images.resampled(flat, 4, 15) == 83).all()
    ramp = np.tile(np.arange(64, dtype=np.uint8)[None, :, None] * 3, (8, 1, 1))
    small = images.resampled(ramp, 4, 32)[0, :, 0].astype(int)
    assert np.abs(np.diff(small)[2:-2] - 6).max() <= 1
    assert np.allclose(images._weights(10, 4).sum(axis=1), 1)


def test_stacks_of_prompts_join(spark):
    rng = np.random.default_rng(3)
    pack = lambda m: bytearray(np.packbits(m).tobytes())
    a, b, c = (rng.random((4, 6)) < 0.5 for _ in range(3))
    rows = [(1, "cup", 0, 4, 6, pack(a)), (1, "cup", 1, 4, 6, pack(b)), (1, "dish", 0, 6, 4, pack(c.T)), (1, "dish", 1, 4, 6, pack(a)), (2, "cup", 0, 4, 6, pack(c))]
    masks = spark.createDataFrame(rows, "frame int, prompt string, idx int, h int, w int, data binary")
    frames = spark.createDataFrame([(1, 4, 6), (2, 4, 6), (3, 4, 6)], "frame int, h int, w int")
    got = {(r["frame"], r["idx"]): bytes(r["data"]) for r in images.joined_stacks(masks, frames).collect()}
    assert got == {(1, 0): bytes(pack(a)), (1, 1): bytes(pack(b)), (1, 2): bytes(pack(c)), (2, 0): bytes(pack(c))}
    assert images.joined_stacks(masks.limit(0), frames).count() == 0
    with pytest.raises(Exception, match="for a frame of"):
        images.joined_stacks(masks, frames.withColumn("h", F.lit(5))).collect()
    stack = images.joined_stacks(masks, frames)
    over = {(r["frame"], r["idx"], r["other"]): (r["inter"], r["pred"], r["gt"]) for r in images.packed_overlaps(stack, stack).collect()}
    assert over[1, 0, 2] == (int((a & c).sum()), int(a.sum()), int(c.sum())) and len(over) == 10


def test_json_results_and_defaults(spark, tmp_path):
    import json

    from gneiss.sources import reports

    df = spark.createDataFrame([("a", 0.5, None), ("b", None, 3)], "scene string, miou double, k int")
    reports.write_json_results(df, f"file://{tmp_path}/json", "scene")
    assert {p.name: json.loads(p.read_text()) for p in (tmp_path / "json").iterdir()} == {"a.json": {"miou": 0.5, "k": None}, "b.json": {"miou": None, "k": 3}}
    with pytest.raises(Exception, match="two results"):
        reports.write_json_results(df.union(df), f"file://{tmp_path}/twice", "scene")
    got = reports.with_defaults(df, {"k": 7, "gpu": "none"}).orderBy("scene").collect()
    assert [(r["k"], r["gpu"]) for r in got] == [(7, "none"), (3, "none")]


def test_last_path_that_a_pattern_matches(spark):
    from gneiss.sources.records import last_matches

    paths = spark.createDataFrame([(p,) for p in ("out/a/run-1/masks", "out/a/run-2/masks", "out/a/run-2/x/masks", "out/b.c/run-9/masks", "out/bxc/run-10/masks", "top")], "path string")
    rows = [("a", "out/{scene}/run-*/masks"), ("b.c", "out/{scene}/run-?/masks"), ("z", "out/{scene}/*"), ("t", "to?"), ("n", None)]
    got = {r["scene"]: r["path"] for r in last_matches(spark.createDataFrame(rows, "scene string, pattern string"), paths).collect()}
    assert got == {"a": "out/a/run-2/masks", "b.c": "out/b.c/run-9/masks", "z": None, "t": "top", "n": None}
