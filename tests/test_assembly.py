"""Scenes of four kinds, written as small files, against numpy."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest

from gneiss.sources import assembly

RNG = np.random.default_rng(5)


def quaternion_rows(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def unit():
    q = RNG.normal(size=4)
    return q / np.linalg.norm(q)


def reconstruction(folder, names, text=False):
    """Files of a reconstruction with one camera; the poses and points that they hold."""
    folder.mkdir(parents=True)
    poses, points = {n: (unit(), RNG.normal(size=3)) for n in names}, RNG.normal(size=(7, 3)) + 4
    if text:
        (folder / "cameras.txt").write_text("# c\n3 PINHOLE 640 480 500 400 320 240\n")
        (folder / "images.txt").write_text("".join(f"{i} {' '.join(map(repr, map(float, (*q, *t))))} 3 {n}\n1 2 -1\n" for i, (n, (q, t)) in enumerate(poses.items())))
        (folder / "points3D.txt").write_text("".join(f"{i} {' '.join(map(repr, map(float, p)))} 255 0 51 0.5 1 2\n" for i, p in enumerate(points)))
        return poses, points
    (folder / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 3, 1, 640, 480, 500, 400, 320, 240))
    rows = [struct.pack("<i7di", i, *q, *t, 3) + n.encode() + b"\0" + struct.pack("<Q2dq", 1, 1, 2, -1) for i, (n, (q, t)) in enumerate(poses.items())]
    (folder / "images.bin").write_bytes(struct.pack("<Q", len(rows)) + b"".join(rows))
    rows = [struct.pack("<Q3d3BdQ", i, *p, 255, 0, 51, 0.5, 1) + struct.pack("<ii", 1, 2) for i, p in enumerate(points)]
    (folder / "points3D.bin").write_bytes(struct.pack("<Q", len(rows)) + b"".join(rows))
    return poses, points


def view(r):
    """The 4 x 4 view of a row."""
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = np.array(r["rotation"]).T, r["translation"]
    return m


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("scenes")
    known = {"static": reconstruction(root / "static" / "sparse" / "0", [f"sub/{i:04d}.png" for i in reversed(range(18))]), "plain": reconstruction(root / "plain" / "sparse" / "0", ["b.png", "a.png"], text=True)}
    # A transforms file beside a reconstruction does not count.
    (root / "static" / "transforms_train.json").write_text(json.dumps({"frames": []}))

    def posed():
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = quaternion_rows(unit()), RNG.normal(size=3)
        return m

    for name, head in [("blend", {"camera_angle_x": 0.7, "w": 40, "h": 20}), ("clip", {"fl_x": 50.0, "fl_y": 60.0, "cx": 1, "cy": 1, "w": 40, "h": 20}), ("technicolor", {})]:
        (root / name).mkdir()
        known[name] = {}
        for part, n in (("train", 3), ("test", 2)):
            matrices = [posed() for _ in range(n)]
            own = {} if head else {"fl_x": 30.0, "fl_y": 30.0, "w": 10, "h": 10}
            frames = [{"file_path": f"{part}/cam_{i + 149:04d}", "time": i + 1.0, "transform_matrix": m.tolist(), **own} for i, m in enumerate(matrices)]
            (root / name / f"transforms_{part}.json").write_text(json.dumps({**head, "frames": frames}))
            known[name][part] = matrices

    def dataset(folder, ids, **lists):
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "dataset.json").write_text(json.dumps({"ids": ids, **lists}))
        (folder / "metadata.json").write_text(json.dumps({i: {"time_id": k, "camera_id": 0} for k, i in enumerate(ids)}))

    ids = [f"{i:06d}" for i in range(10)]
    dataset(root / "misc" / "cap", ids)
    (root / "misc" / "cap" / "scene.json").write_text(json.dumps({"scale": 0.5, "center": [1.0, 2.0, 3.0]}))
    (root / "misc" / "cap" / "camera").mkdir()
    known["cap"] = {}
    for i in ids:
        turn, position = quaternion_rows(unit()), RNG.normal(size=3)
        known["cap"][i] = turn, position
        (root / "misc" / "cap" / "camera" / f"{i}.json").write_text(json.dumps({"orientation": turn.tolist(), "position": position.tolist(), "focal_length": 100.0, "image_size": [21, 30]}))
    known["cloud"] = RNG.normal(size=(5, 3))
    np.save(root / "misc" / "cap" / "points.npy", known["cloud"])
    dataset(root / "vrig-set" / "rec", ids, train_ids=ids[:3], val_ids=ids[5:7])
    known["rec"] = reconstruction(root / "vrig-set" / "rec" / "colmap" / "sparse" / "0", [f"{i}.png" for i in ids])
    (root / "notes").mkdir()
    (root / "notes" / "readme.json").write_text("{}")
    return root, known


def by_scene(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["scene"].rsplit("/", 1)[1], []).append(r)
    return found


def test_kinds(spark, root):
    kinds = {s: (r[0]["kind"], r[0]["binary"]) for s, r in by_scene(assembly.scene_kinds(spark, str(root[0]))).items()}
    assert {s: k for s, (k, _) in kinds.items()} == {"static": "reconstruction", "plain": "reconstruction", "blend": "transforms", "clip": "transforms", "technicolor": "transforms", "cap": "capture", "rec": "posed"}
    assert kinds["static"][1] and kinds["rec"][1] and not kinds["plain"][1]


def test_unknown_folder_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="no scene"):
        assembly.read_scenes(spark, str(tmp_path))


def test_four_kinds_of_cameras(spark, root):
    root, known = root
    got = by_scene(assembly.read_scenes(spark, str(root)).cameras)
    for rows in got.values():
        rows.sort(key=lambda r: r["at"])
        assert [r["at"] for r in rows] == list(range(len(rows))) and {r["part"] for r in rows} == {"train"}
    assert {s: len(r) for s, r in got.items()} == {"static": 18, "plain": 2, "blend": 5, "clip": 5, "technicolor": 5, "cap": 5, "rec": 5}
    poses = known["static"][0]
    assert [r["name"] for r in got["static"]] == [f"{i:04d}" for i in range(18)]
    for r in got["static"]:
        q, t = poses[f"sub/{r['name']}.png"]
        assert np.allclose(view(r)[:3, :3], quaternion_rows(q)) and np.allclose(r["translation"], t)
        assert r["time"] == int(r["name"]) / 17 and r["uid"] == 3 and r["image_path"].endswith(f"/static/images/{r['name']}.png")
        assert np.allclose((r["fov_x"], r["fov_y"]), (2 * np.arctan(640 / 1000), 2 * np.arctan(480 / 800)))
    assert [(r["name"], r["time"]) for r in got["plain"]] == [("a", 0.0), ("b", 0.0)]
    flip = np.diag([1.0, -1.0, -1.0, 1.0])
    for name, time in (("blend", 1.0), ("clip", 10.0), ("technicolor", 10 / 6)):
        matrices = known[name]["train"] + known[name]["test"]
        for r, m in zip(got[name], matrices, strict=True):
            assert np.allclose(view(r), m if name == "technicolor" else np.linalg.inv(m @ flip))
        assert np.allclose([r["time"] for r in got[name]], np.array([1, 2, 3, 1, 2]) / time)
    assert np.allclose([(r["fov_x"], r["fov_y"]) for r in got["blend"]], (0.7, 2 * np.arctan(20 / (2 * 40 / (2 * np.tan(0.35))))))
    assert np.allclose([r["fov_y"] for r in got["clip"]], 2 * np.arctan(20 / 120))
    for r in got["cap"]:
        turn, position = known["cap"][r["name"]]
        assert np.allclose(np.linalg.inv(view(r))[:3, 3], (position - [1, 2, 3]) * 0.5) and np.allclose(view(r)[:3, :3], turn)
        assert (r["width"], r["height"]) == (10, 15) and r["time"] == int(r["name"]) / 8
        assert r["image_path"].endswith(f"/cap/rgb/2x/{r['name']}.png")
    assert [r["name"] for r in got["cap"]] == [f"{i:06d}" for i in (0, 4, 8, 2, 6)]


def test_posed_scene_is_recentred(spark, root):
    root, known = root
    tables = assembly.read_scenes(spark, str(root / "vrig-set"))
    (rows,) = by_scene(tables.cameras).values()
    poses, points = known["rec"]
    names = [f"{i:06d}" for i in (0, 1, 2, 5, 6)]
    rows.sort(key=lambda r: r["at"])
    assert [r["name"] for r in rows] == names and all(r["time"] == int(r["name"]) / 9 for r in rows)
    centres = np.array([-quaternion_rows(poses[f"{n}.png"][0]).T @ poses[f"{n}.png"][1] for n in names])
    # First the cameras' own frame, then the mean of the points seen in it.
    middle = centres.mean(0)
    radius = np.linalg.norm(centres - middle, axis=1).max()
    seen, cloud = (centres - middle) / radius, (points - middle) / radius
    got = np.array([np.linalg.inv(view(r))[:3, 3] for r in rows])
    assert np.allclose(got, seen - cloud.mean(0))
    xyz = np.array([r["xyz"] for r in tables.points.orderBy("id").collect()])
    assert np.allclose(xyz, cloud - cloud.mean(0)) and tables.points.first()["rgb"] == [1.0, 0.0, 0.2]
    assert [(r["middle"], r["radius"]) for r in tables.bounds.collect()] == [([0.0, 0.0, 0.0], 1.0)]


def test_parts_points_and_bounds(spark, root):
    root, known = root
    tables = assembly.read_scenes(spark, str(root), held_out=True, end_frame=150)
    got = by_scene(tables.cameras)
    parts = {s: sorted((r["part"], r["name"]) for r in rows) for s, rows in got.items()}
    assert [n for p, n in parts["static"] if p == "test"] == ["0000", "0008", "0016"]
    assert parts["rec"] == [("test", "000005"), ("test", "000006"), ("train", "000000"), ("train", "000001"), ("train", "000002")]
    assert [n for p, n in parts["cap"] if p == "train"] == ["000000", "000004", "000008"]
    assert parts["clip"] == [("test", "cam_0149"), ("test", "cam_0150"), ("train", "cam_0149"), ("train", "cam_0150")]
    assert len(parts["blend"]) == 5 and {r["time"] for r in got["clip"]} == {1 / 5, 2 / 5}
    points = by_scene(tables.points)
    assert {s: len(p) for s, p in points.items()} == {"static": 7, "plain": 7, "rec": 7, "cap": 5}
    assert np.allclose([r["xyz"] for r in sorted(points["cap"], key=lambda r: r["id"])], (known["cloud"] - [1, 2, 3]) * 0.5)
    assert all(r["rgb"] == [1.0, 0.0, 0.2] for r in points["plain"])
    bounds = {s: r[0] for s, r in by_scene(tables.bounds).items()}
    training = np.array([np.linalg.inv(m)[:3, 3] for m in known["technicolor"]["train"][:2]])
    assert np.allclose(bounds["technicolor"]["middle"], training.mean(0)) and np.isclose(bounds["technicolor"]["radius"], np.linalg.norm(training - training.mean(0), axis=1).max())


def test_missing_camera_raises_and_sizes_are_taken(spark, tmp_path):
    scene = tmp_path / "a" / "b"
    scene.mkdir(parents=True)
    (scene / "dataset.json").write_text(json.dumps({"ids": ["x"]}))
    (scene / "metadata.json").write_text(json.dumps({"x": {"time_id": 0}}))
    (scene / "scene.json").write_text(json.dumps({"scale": 1.0, "center": [0, 0, 0]}))
    with pytest.raises(Exception, match="no camera for"):
        assembly.read_scenes(spark, str(tmp_path)).cameras.collect()
    other = tmp_path / "c"
    other.mkdir()
    for part in ("train", "test"):
        (other / f"transforms_{part}.json").write_text(json.dumps({"camera_angle_x": 0.5, "frames": [{"file_path": f"{part}0001", "time": 0.5, "transform_matrix": np.eye(4).tolist()}]}))
    sizes = spark.createDataFrame([(f"file://{other}/train0001.png", 30, 15)], "image_path string, width long, height long")
    rows = assembly.read_scenes(spark, str(other), sizes=sizes).cameras.orderBy("at").collect()
    assert [(r["name"], r["width"], r["height"]) for r in rows] == [("train0001", 30, 15), ("test0001", None, None)]
    assert np.allclose(np.tan(rows[0]["fov_y"] / 2), np.tan(0.25) / 2) and rows[1]["fov_x"] == 0.5 and rows[1]["fov_y"] is None
