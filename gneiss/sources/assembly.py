"""Whole scenes of four kinds, any number below one folder, as tables of cameras and points.

A folder is a scene by what lies in it, the first of these that fits:

* ``reconstruction``: ``sparse/0`` with images and cameras, binary or text
* ``transforms``: ``transforms_train.json`` and ``transforms_test.json``
* ``posed``: ``dataset.json`` and a reconstruction below ``colmap``
* ``capture``: ``dataset.json``, ``metadata.json``, ``scene.json``, ``camera/<id>.json``

Files are listed and read by Spark's own sources, all scenes at once; what holds
the frames of one scene together is its folder as a key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import rigid as rg
from gneiss.functions.geometry import field_of_view
from gneiss.operators import affinity as af
from gneiss.operators import framing
from gneiss.sources import arrays, reconstructions, scenes

#: Columns of every kind's cameras.
CAMERAS = ["scene", "kind", "part", "at", "uid", "name", "image_path", "time", "width", "height", "fov_x", "fov_y", "rotation", "translation"]
#: Columns of every kind's points; colours are 0 to 1.
POINTS = ["scene", "kind", "id", "xyz", "rgb"]
#: Every eighth image of a reconstruction, in order of names, is held out.
HOLD = 8


@dataclass
class Scenes:
    """Cameras, points and ``(scene, middle, radius)`` of the training cameras."""

    cameras: DataFrame
    points: DataFrame
    bounds: DataFrame


def _listed(spark: SparkSession, names: str, kind: str = "binaryFile", **options) -> DataFrameReader:
    """A reader of kind ``kind`` of all files below a folder under names of a pattern."""
    return spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", names).options(**options)


def _below(reader: DataFrameReader, root: str, tail: str, *columns) -> DataFrame:
    """Rows of files whose path ends in ``tail``, with the folder before it as ``scene``."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, f"^(.*)/{tail}$", 1)
    return reader.load(root).select(path.alias("path"), folder.alias("scene"), *columns).where("scene <> ''")


SPARSE, COLMAP = r"(?<!/colmap/)sparse/0/", r"colmap/(?:colmap_)?sparse/0/"


def scene_kinds(spark: SparkSession, root: str) -> DataFrame:
    """``(scene, kind, binary, binary_points)``: each scene's folder and kind, and whether its reconstruction is read from binary files.

    Only names are read.  Folders of no kind are no scenes.
    """
    files = _listed(spark, "{images.bin,images.txt,cameras.bin,points3D.bin,transforms_train.json,dataset.json}").load(root).select(F.col("_metadata.file_path").alias("path"))
    tail = F.regexp_extract("path", rf"/({SPARSE}|{COLMAP})?([^/]+)$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    depth = F.length("path") - F.length(tail) - F.length(name) - 1
    marked = files.select(F.substr("path", F.lit(1), depth).alias("scene"), tail.alias("tail"), name.alias("name"))
    has = lambda tail, name: F.bool_or(F.startswith("tail", F.lit(tail)) & F.col("name").startswith(name))
    plain = lambda name: F.bool_or((F.col("tail") == "") & (F.col("name") == name))
    seen = marked.groupBy("scene").agg(
        has("sparse", "images").alias("s"), plain("transforms_train.json").alias("t"), plain("dataset.json").alias("d"), has("colmap", "images").alias("c"),
        *(F.bool_or((F.col("tail") != "") & (F.col("name") == f"{n}.bin")).alias(n) for n in ("images", "cameras", "points3D")),
    )
    kind = F.when(F.col("s"), "reconstruction").when(F.col("t"), "transforms").when(F.col("d") & F.col("c"), "posed").when(F.col("d"), "capture")
    return seen.select("scene", kind.alias("kind"), (F.col("images") & F.col("cameras")).alias("binary"), F.col("points3D").alias("binary_points")).where("kind IS NOT NULL")


def _of_kind(rows: DataFrame, kinds: DataFrame, kind: str, also: str = "true") -> DataFrame:
    """The rows of scenes of a kind."""
    wanted = kinds.where((F.col("kind") == kind) & F.expr(also)).select("scene")
    return rows.join(wanted, "scene", "left_semi")


def _rows(matrix: rg.Matrix) -> Column:
    return F.array(*(F.array(*row) for row in matrix))


def _stem(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/]*?)(\.[^./]*)?$", 1)


def _transforms(spark: SparkSession, root: str, kinds: DataFrame, end_frame: int | None, extension: str, sizes: DataFrame | None) -> DataFrame:
    """Frames of transform files.

    One angle for all frames means cameras without a clock; focal lengths for all frames, else one
    a frame, mean clips of ten seconds (ten sixths below a ``technicolor`` path),
    or of the first ``end_frame`` of 300 frames, later ones being left out.
    Matrices are views where focal lengths are given by frame, else camera to
    world with y up.
    """
    frame = "struct<file_path:string,time:double,transform_matrix:array<array<double>>,fl_x:double,fl_y:double,w:long,h:long>"
    schema = f"camera_angle_x double, fl_x double, fl_y double, cx double, cy double, w long, h long, frames array<{frame}>"
    reader = _listed(spark, "transforms_{train,test}.json", "json", multiLine=True).schema(schema)
    part = F.regexp_extract("_metadata.file_path", r"transforms_(\w+)\.json$", 1)
    files = _of_kind(_below(reader, root, r"transforms_(?:train|test)\.json", part.alias("part"), "*"), kinds, "transforms")
    f = files.select("*", F.posexplode("frames").alias("_at", "f"))
    angle = F.col("camera_angle_x").isNotNull()
    shared = ~angle & F.col("fl_x").isNotNull() & F.col("fl_y").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull()
    if end_frame is None:
        seconds = F.when(~shared & F.contains("scene", F.lit("technicolor")), 10 / 6).otherwise(10.0)
    else:
        seconds = F.lit(end_frame / 300 * 10)
        f = f.where(angle | (F.substring(F.element_at(F.split("f.file_path", "/"), -1), -4, 4).cast("int") <= end_frame))
    f = f.withColumn("image_path", F.concat("scene", F.lit("/"), "f.file_path", F.lit(extension)))
    width, height = F.coalesce("f.w", "w"), F.coalesce("f.h", "h")
    if sizes is not None:
        bare = lambda path: F.regexp_replace(path, "^file:/+", "/")
        known = sizes.select(bare("image_path").alias("_image"), F.col("width").alias("_w"), F.col("height").alias("_h"))
        f = f.join(known, bare("image_path") == F.col("_image"), "left")
        width, height = F.coalesce(width, "_w"), F.coalesce(height, "_h")
    m = [rg.vector(F.get("f.transform_matrix", i)) for i in range(3)]
    last = [F.get(F.get("f.transform_matrix", i), 3) for i in range(3)]
    # Inverse of the turned camera axes: cofactors over the determinant.
    turned = [[row[0], -row[1], -row[2]] for row in m]
    cofactors = [rg.cross(turned[1], turned[2]), rg.cross(turned[2], turned[0]), rg.cross(turned[0], turned[1])]
    determinant = sum((turned[0][i] * cofactors[0][i] for i in range(1, 3)), turned[0][0] * cofactors[0][0])
    inverse = [[c / determinant for c in row] for row in cofactors]  # transposed, as cameras hold it
    view = ~angle & ~shared
    wide = F.when(angle, width / (2 * F.tan(F.col("camera_angle_x") / 2)))
    focal = [F.coalesce(wide, F.when(shared, F.col(c)).otherwise(F.col(f"f.{c}"))) for c in ("fl_x", "fl_y")]
    return f.select(
        "scene", F.lit("transforms").alias("kind"), "part", F.col("_at").cast("long").alias("at"), F.col("_at").cast("long").alias("uid"), _stem(F.concat("f.file_path", F.lit(extension))).alias("name"),
        "image_path", F.when(angle, F.col("f.time")).otherwise(F.col("f.time") / seconds).alias("time"), width.alias("width"), height.alias("height"),
        F.when(angle, F.col("camera_angle_x")).otherwise(field_of_view(focal[0], width)).alias("fov_x"), field_of_view(focal[1], height).alias("fov_y"),
        F.when(view, _rows(rg.transposed(m))).otherwise(_rows(inverse)).alias("rotation"),
        F.when(view, F.array(*last)).otherwise(F.array(*rg.scaled(rg.times(rg.transposed(inverse), last), -1.0))).alias("translation"),
    )


def _reconstructed(spark: SparkSession, root: str, kinds: DataFrame, kind: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Posed images with their cameras, and points, of scenes whose reconstruction lies in ``folder``.

    ``time`` is an image's number among the scene's images where its name is one, else 0.
    """

    def binary(name: str, which: str = "binary") -> DataFrame:
        return _of_kind(_below(_listed(spark, f"{name}.bin"), root, rf"{folder}{name}\.bin", "content"), kinds, kind, which).select("path", "content")

    def text(name: str, which: str = "binary", whole: bool = False) -> DataFrame:
        return _of_kind(_below(_listed(spark, f"{name}.txt", "text", wholetext=whole), root, rf"{folder}{name}\.txt", "value"), kinds, kind, f"NOT {which}")

    scene = F.regexp_extract("path", rf"^(.*)/{folder}[^/]+$", 1).alias("scene")
    q = ["scene", "camera_id", "name"]
    images = reconstructions.images_of(binary("images")).select(scene, "*").select(*q, F.col("rotation").alias("q"), F.col("translation").alias("t"))
    images = images.union(scenes.images_of_text(text("images", whole=True)).select(scene, "*").select(*q, F.col("qvec").alias("q"), F.col("tvec").alias("t")))
    c = ["scene", "id", "model", "width", "height", "params"]
    cameras = reconstructions.cameras_of(binary("cameras")).select(scene, "*").select(c)
    cameras = cameras.union(scenes.cameras_of_text(text("cameras")).select(scene, "*").select(c))
    p = ["scene", "id", "xyz", "rgb"]
    points = reconstructions.points_of(binary("points3D", "binary_points")).select(scene, "*").select(p)
    points = points.union(scenes.points_of_text(text("points3D", "binary_points")).select(scene, "*").select(p))
    colours = F.transform("rgb", lambda v: v / 255.0).alias("rgb")
    points = points.select("scene", F.lit(kind).alias("kind"), "id", "xyz", colours)

    model = F.col("model")
    second = F.when(model == "SIMPLE_PINHOLE", F.get("params", 0)).when(model.isin("PINHOLE", "OPENCV", "SIMPLE_RADIAL"), F.get("params", 1))
    second = F.when(second.isNull(), F.raise_error(F.concat(F.lit("camera model is not handled: "), F.coalesce(model, F.lit("none"))))).otherwise(second)
    name = F.get(F.split(F.element_at(F.split("name", "/"), -1), r"\."), 0)
    number = F.coalesce(F.try_divide(name.try_cast("int").cast("double"), F.count("*").over(Window.partitionBy("scene")) - 1), F.lit(0.0))
    named = cameras.withColumnRenamed("scene", "_scene")
    joined = images.join(named, (F.col("scene") == F.col("_scene")) & (F.col("camera_id") == F.col("id")), "left")
    rows = joined.select(
        "scene", F.lit(kind).alias("kind"), F.col("camera_id").cast("long").alias("uid"), name.alias("name"), F.element_at(F.split("name", "/"), -1).alias("file"), number.alias("time"), "width", "height",
        field_of_view(F.get("params", 0), F.col("width")).alias("fov_x"), field_of_view(second, F.col("height")).alias("fov_y"), _rows(rg.transposed(af.rotation_rows(F.col("q")))).alias("rotation"), F.col("t").alias("translation"),
    )
    return rows, points


def _static(rows: DataFrame, images: str) -> DataFrame:
    """Images of a reconstruction in order of names; every eighth is of the test part."""
    at = (F.row_number().over(Window.partitionBy("scene").orderBy("name", "file")) - 1).cast("long")
    part = F.when(F.col("at") % HOLD == 0, "test").otherwise("train")
    return rows.withColumn("at", at).withColumn("part", part).withColumn("image_path", F.concat_ws("/", "scene", F.lit(images), "file")).select(CAMERAS)


def _picked(spark: SparkSession, root: str, kinds: DataFrame, kind: str) -> DataFrame:
    """``(scene, at, name, part, ratio)`` of the images that ``dataset.json`` picks.

    Scenes below ``vrig…`` and ``NeRF…`` folders name their parts; of others every
    fourth image trains, and every fourth from the third on tests (none of a
    posed one below no ``interp…`` folder).
    """
    reader = _listed(spark, "dataset.json", "json", multiLine=True).schema("ids array<string>, train_ids array<string>, val_ids array<string>")
    files = _of_kind(_below(reader, root, r"dataset\.json", "ids", "train_ids", "val_ids"), kinds, kind)
    family = F.coalesce(F.try_element_at(F.split("scene", "/"), F.lit(-2)), F.lit(""))
    named = family.startswith("vrig") | family.startswith("NeRF")
    fourth = lambda first: F.filter("ids", lambda _, i: i % 4 == first)
    tests = F.when(named, F.col("val_ids")).when(F.lit(kind == "posed") & ~family.startswith("interp"), F.array().cast("array<string>")).otherwise(fourth(2))
    ratio = F.when(family.startswith("vrig"), 0.25).when(F.lit(kind == "posed") & family.startswith("NeRF"), 1.0).otherwise(0.5)
    lists = files.select("scene", ratio.alias("ratio"), F.when(named, F.col("train_ids")).otherwise(fourth(0)).alias("train"), tests.alias("test"))
    both = lists.select("scene", "ratio", F.size("train").alias("n"), F.posexplode(F.concat("train", F.coalesce("test", F.array().cast("array<string>")))).alias("at", "name"))
    return both.select("scene", F.col("at").cast("long").alias("at"), "name", F.when(F.col("at") < F.col("n"), "train").otherwise("test").alias("part"), "ratio")


def _image_path(suffix: Column) -> Column:
    return F.concat("scene", F.lit("/rgb/"), (1 / F.col("ratio")).cast("int").cast("string"), F.lit("x/"), suffix)


def _missing(what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"no {what} for "), "scene", F.lit(" "), "name"))


def _posed(spark: SparkSession, root: str, kinds: DataFrame, rows: DataFrame) -> DataFrame:
    """Picked images with their poses by name; one without a pose raises."""
    picked = _picked(spark, root, kinds, "posed")
    # Of images that share a name the last counts, by file and camera.
    last = rows.groupBy("scene", "name").agg(F.max_by(F.struct("uid", "file", "time", "width", "height", "fov_x", "fov_y", "rotation", "translation"), F.struct("file", "uid")).alias("r"))
    joined = picked.join(last, ["scene", "name"], "left").withColumn("r", F.when(F.col("r").isNull(), _missing("pose")).otherwise(F.col("r")))
    return joined.select("scene", F.lit("posed").alias("kind"), "part", "at", "name", _image_path(F.col("r.file")).alias("image_path"), "r.*").select(CAMERAS)


def _captured(spark: SparkSession, root: str, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Picked images with their camera files, moved and scaled as ``scene.json`` says, and the scene's ``points.npy``.

    ``time`` is the share of the latest time among the picked ones.
    """
    picked = _picked(spark, root, kinds, "capture")
    texts = _below(_listed(spark, "metadata.json", "text", wholetext=True), root, r"metadata\.json", "value")
    about = texts.select("scene", F.explode(F.from_json("value", "map<string,struct<time_id:double>>")).alias("name", "about")).select("scene", "name", "about.time_id")
    frames = _below(_listed(spark, "scene.json", "json", multiLine=True).schema("scale double, center array<double>"), root, r"scene\.json", "scale", "center")
    camera = "orientation array<array<double>>, position array<double>, focal_length double, image_size array<double>"
    files = _below(_listed(spark, "*.json", "json", multiLine=True).schema(camera), root, r"camera/[^/]+\.json", "orientation", "position", "focal_length", "image_size")
    cameras = files.withColumn("name", F.regexp_extract("path", r"([^/]+)\.json$", 1)).drop("path")
    df = picked.join(about, ["scene", "name"], "left").join(cameras, ["scene", "name"], "left").join(frames.drop("path"), "scene", "left")
    name = F.when(F.col("time_id").isNull(), _missing("time")).when(F.col("position").isNull(), _missing("camera")).when(F.col("scale").isNull(), _missing("scene.json")).otherwise(F.col("name"))
    df = df.withColumn("time", F.coalesce(F.try_divide("time_id", F.max("time_id").over(Window.partitionBy("scene"))), F.lit(0.0)))
    width, height = (F.bround(F.get("image_size", i) * F.col("ratio")).cast("long") for i in (0, 1))
    position = [(F.get("position", i) - F.get("center", i)) * F.col("scale") for i in range(3)]
    turn = [rg.vector(F.get("orientation", i)) for i in range(3)]
    focal = F.col("focal_length") * F.col("ratio")
    rows = df.select(
        "scene", F.lit("capture").alias("kind"), "part", "at", F.col("at").alias("uid"), name.alias("name"), _image_path(F.concat("name", F.lit(".png"))).alias("image_path"), "time", width.alias("width"), height.alias("height"),
        field_of_view(focal, width).alias("fov_x"), field_of_view(focal, height).alias("fov_y"), _rows(rg.transposed(turn)).alias("rotation"), F.array(*rg.scaled(rg.times(turn, position), -1.0)).alias("translation"),
    )
    clouds = _of_kind(_below(_listed(spark, "points.npy"), root, r"points\.npy", "content"), kinds, "capture")
    scattered = arrays.rows_of(clouds.select("path", "content")).withColumn("scene", F.regexp_extract("path", r"^(.*)/points\.npy$", 1)).join(frames.drop("path"), "scene")
    moved = F.array(*((F.get("values", i) - F.get("center", i)) * F.col("scale") for i in range(3)))
    points = scattered.select("scene", F.lit("capture").alias("kind"), F.col("at").alias("id"), moved.alias("xyz"), F.lit(None).cast("array<double>").alias("rgb"))
    return rows, points


def read_scenes(spark: SparkSession, root: str, held_out: bool = False, end_frame: int | None = None, images: str = "images", extension: str = ".png", sizes: DataFrame | None = None) -> Scenes:
    """All scenes at or below ``root``; none there raises.

    Unless ``held_out``, test cameras count as training cameras, behind them in
    ``at``.  Cameras of ``posed`` scenes are brought, with their points, to the
    points' mean and to the largest distance of a camera from the cameras' mean,
    in both parts alike, and have the bounds 0 and 1.  Points of ``transforms``
    scenes are .ply files (format ``ply``); captured points have no colour.  Frames
    without a size get theirs from ``sizes``: ``(image_path, width, height)``.
    """
    kinds = scene_kinds(spark, root)
    # At most four values: only what there is becomes part of the plan.
    present = {r["kind"] for r in kinds.select("kind").distinct().collect()}
    if not present:
        raise ValueError(f"no scene at or below {root}")
    cameras, points = [], []
    if "reconstruction" in present:
        rows, cloud = _reconstructed(spark, root, kinds, "reconstruction", SPARSE)
        cameras.append(_static(rows, images))
        points.append(cloud)
    if "transforms" in present:
        cameras.append(_transforms(spark, root, kinds, end_frame, extension, sizes))
    if "posed" in present:
        rows, cloud = _reconstructed(spark, root, kinds, "posed", COLMAP)
        rows = _posed(spark, root, kinds, rows)
        # The points' mean and the cameras' radius are the frame of a posed scene.
        middles = cloud.groupBy("scene").agg(F.array(*(F.avg(F.get("xyz", i)) for i in range(3))).alias("middle"))
        frames = framing.bounds(rows).select("scene", F.col("radius").alias("divisor")).join(middles, "scene")
        cameras.append(framing.placed_cameras(rows, frames))
        points.append(framing.placed_points(cloud, frames))
    if "capture" in present:
        rows, cloud = _captured(spark, root, kinds)
        cameras.append(rows)
        points.append(cloud)
    cameras = reduce(DataFrame.union, (c.select(CAMERAS) for c in cameras))
    points = reduce(DataFrame.union, (p.select(POINTS) for p in points), spark.createDataFrame([], "scene string, kind string, id long, xyz array<double>, rgb array<double>"))
    if not held_out:
        behind = F.row_number().over(Window.partitionBy("scene").orderBy((F.col("part") == "test") & (F.col("kind") == "transforms"), "at")) - 1
        cameras = cameras.withColumn("at", behind.cast("long")).withColumn("part", F.lit("train"))
    training = cameras.where("part = 'train'")
    bounds = framing.bounds(training.where("kind <> 'posed'"))
    if "posed" in present:
        fixed = training.where("kind = 'posed'").select("scene").distinct()
        bounds = bounds.union(fixed.select("scene", F.array(*[F.lit(0.0)] * 3).alias("middle"), F.lit(1.0).alias("radius")))
    return Scenes(cameras, points, bounds)
