"""Queries that score cluster maps; ``events`` carries the pixels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions.safe import f6, iou, ratio
from gneiss.operators import evaluation as ev
from gneiss.operators import sweeps
from gneiss.operators.ordering import positions
from gneiss.plans.carriers import SQL, pixels
from gneiss.session import table
from gneiss.storage import materialise, new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PIX = f"WITH {SQL['pixels']}"
COUNTS = (
    PIX + ", c0 AS (SELECT frame, k, count(*) FILTER (gt) AS inter, count(*) AS pred FROM pixels GROUP BY ALL), "
    "fr AS (SELECT frame, count(*) FILTER (gt) AS gt, count(*) AS pixels FROM pixels GROUP BY ALL), "
    "counts AS (SELECT fr.frame, k.k, coalesce(inter, 0) AS inter, coalesce(pred, 0) AS pred, gt, pixels FROM fr CROSS JOIN (SELECT DISTINCT k FROM c0) k LEFT JOIN c0 ON c0.frame = fr.frame AND c0.k = k.k)"
)
IOU = "CASE WHEN {p} + {g} - {i} = 0 THEN 0 ELSE ({i})::DOUBLE / ({p} + {g} - {i}) END"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _iou(i: str, p: str, g: str) -> str:
    return IOU.format(i=i, p=p, g=g)


@query("pooled_iou_best", COUNTS + f", s AS (SELECT k, sum(inter)::BIGINT AS inter, sum(pred)::BIGINT AS pred, sum(gt)::BIGINT AS gt FROM counts GROUP BY k) SELECT k, inter, pred, gt, round({_iou('inter', 'pred', 'gt')}, 6) AS iou FROM s ORDER BY {_iou('inter', 'pred', 'gt')} DESC, k LIMIT 1")
def _(spark, d):
    return ev.best(ev.pooled_iou(ev.frame_counts(pixels(spark, d))), "iou").withColumn("iou", f6(F.col("iou")))


@query("frame_cluster_counts", COUNTS + " SELECT frame, k, inter, pred, gt, pixels FROM counts WHERE pred > 0")
def _(spark, d):
    return ev.frame_counts(pixels(spark, d))


@query("pooled_iou", COUNTS + f", s AS (SELECT k, sum(inter)::BIGINT AS inter, sum(pred)::BIGINT AS pred, sum(gt)::BIGINT AS gt FROM counts GROUP BY k) SELECT k, inter, pred, gt, round({_iou('inter', 'pred', 'gt')}, 6) AS iou FROM s")
def _(spark, d):
    return ev.pooled_iou(ev.frame_counts(pixels(spark, d))).withColumn("iou", f6(F.col("iou")))


@query("frame_mean_iou", COUNTS + f" SELECT k, round(avg({_iou('inter', 'pred', 'gt')}), 6) AS iou, round(avg((pixels - pred - gt + 2 * inter)::DOUBLE / pixels), 6) AS acc, count(*) AS frames FROM counts GROUP BY k")
def _(spark, d):
    return ev.frame_mean_iou(ev.frame_counts(pixels(spark, d))).select("k", f6(F.col("iou")).alias("iou"), f6(F.col("acc")).alias("acc"), "frames")


@query("union_iou", COUNTS + f", u AS (SELECT frame, (sum(inter) FILTER (k IN (1, 3)))::BIGINT AS inter, (sum(pred) FILTER (k IN (1, 3)))::BIGINT AS pred, max(gt) AS gt, max(pixels) AS pixels FROM counts GROUP BY frame) SELECT frame, inter, pred, gt, pixels, round({_iou('inter', 'pred', 'gt')}, 6) AS iou FROM u")
def _(spark, d):
    return ev.union_iou(ev.frame_counts(pixels(spark, d)), [1, 3]).withColumn("iou", f6(F.col("iou")))


@query("union_iou_scene", COUNTS + f", u AS (SELECT (sum(inter) FILTER (k IN (1, 3)))::BIGINT AS inter, (sum(pred) FILTER (k IN (1, 3)))::BIGINT AS pred, (sum(gt) FILTER (k = 1))::BIGINT AS gt FROM counts) SELECT inter, pred, gt, round({_iou('inter', 'pred', 'gt')}, 6) AS iou FROM u")
def _(spark, d):
    whole = ev.union_iou(ev.frame_counts(pixels(spark, d)), [1, 3]).agg(F.sum("inter").alias("inter"), F.sum("pred").alias("pred"), F.sum("gt").alias("gt"))
    return whole.withColumn("iou", f6(iou(F.col("inter"), F.col("pred"), F.col("gt"))))


@query("selected_set_accuracy", COUNTS + ", u AS (SELECT frame, sum(inter) FILTER (k IN (2, 4)) AS i, sum(pred) FILTER (k IN (2, 4)) AS p, max(gt) AS g, max(pixels) AS n FROM counts GROUP BY frame) SELECT frame, round((i + n - (p + g - i))::DOUBLE / n, 6) AS acc FROM u")
def _(spark, d):
    u = ev.union_iou(ev.frame_counts(pixels(spark, d)), [2, 4])
    i, p, g, n = (F.col(c) for c in ("inter", "pred", "gt", "pixels"))
    return u.select("frame", f6(ratio(i + n - (p + g - i), n)).alias("acc"))


@query("mean_accuracy", "SELECT doc_id % 10 AS frame, round(avg((quality = toxic)::INT), 6) AS acc, count(*) AS pixels FROM labels GROUP BY ALL")
def _(spark, d):
    labels = table(spark, d, "labels").withColumn("frame", F.col("doc_id") % 10)
    return ev.mean_accuracy(labels, "frame", F.col("quality"), F.col("toxic")).withColumn("acc", f6(F.col("acc")))


@query("iou_matrix", PIX + f", o AS (SELECT user_id % 3 AS object, k, count(*) FILTER (gt) AS inter, count(*) AS pred FROM pixels GROUP BY ALL), s AS (SELECT k, sum(pred) AS allpred FROM o GROUP BY k), g AS (SELECT object, sum(inter) AS gt FROM o GROUP BY object) SELECT object, k, inter, allpred::BIGINT AS pred, gt::BIGINT AS gt, round({_iou('inter', 'allpred', 'gt')}, 6) AS iou FROM o JOIN s USING (k) JOIN g USING (object)")
def _(spark, d):
    o = pixels(spark, d).groupBy((F.col("user_id") % 3).alias("object"), "k").agg(F.count_if("gt").alias("inter"), F.count("*").alias("own"))
    o = o.withColumn("pred", F.sum("own").over(Window.partitionBy("k"))).withColumn("gt", F.sum("inter").over(Window.partitionBy("object")))
    return o.select("object", "k", "inter", "pred", "gt", f6(iou(F.col("inter"), F.col("pred"), F.col("gt"))).alias("iou"))


@query("matching_accuracy", COUNTS + ", s AS (SELECT k, sum(inter) AS i, sum(pred) AS p, sum(gt) AS g, sum(pixels) AS n FROM counts GROUP BY k) SELECT k, round((n - p - g + 2 * i)::DOUBLE / n, 6) AS acc FROM s")
def _(spark, d):
    s = ev.dense_counts(ev.frame_counts(pixels(spark, d))).groupBy("k").agg(*(F.sum(c).alias(c) for c in ("inter", "pred", "gt", "pixels")))
    i, p, g, n = (F.col(c) for c in ("inter", "pred", "gt", "pixels"))
    return s.select("k", f6(ratio(n - p - g + 2 * i, n)).alias("acc"))


@query("over_segmentation", PIX + " SELECT frame, count(DISTINCT k) AS clusters, max(k) AS max_id, count(DISTINCT user_id % 3) AS objects, round(count(DISTINCT k)::DOUBLE / count(DISTINCT user_id % 3), 6) AS ratio, round(greatest(0, count(DISTINCT k) - count(DISTINCT user_id % 3))::DOUBLE / count(DISTINCT user_id % 3), 6) AS excess FROM pixels GROUP BY frame")
def _(spark, d):
    g = pixels(spark, d).groupBy("frame").agg(F.countDistinct("k").alias("clusters"), F.max("k").alias("max_id"), F.countDistinct(F.col("user_id") % 3).alias("objects"))
    k, o = F.col("clusters"), F.col("objects")
    return g.select("*", f6(ratio(k, o)).alias("ratio"), f6(ratio(F.greatest(F.lit(0), k - o), o)).alias("excess"))


TC = (
    PIX + ", n AS (SELECT frame, user_id, k, count(*) AS c FROM pixels GROUP BY ALL), r AS (SELECT frame, user_id AS pixel, k FROM n QUALIFY row_number() OVER (PARTITION BY frame, user_id ORDER BY c DESC, k) = 1), "
    "o AS (SELECT frame, row_number() OVER (ORDER BY frame) AS t FROM (SELECT DISTINCT frame FROM r)), q AS (SELECT t, pixel, k FROM r JOIN o USING (frame)), "
    "j AS (SELECT a.t, a.k AS a, b.k AS b FROM q a JOIN q b ON a.pixel = b.pixel AND b.t = a.t + 1), "
    "i AS (SELECT t, id, count(*) FILTER (a = id AND b = id) AS inter, count(*) FILTER (a = id) AS na, count(*) FILTER (b = id) AS nb FROM j, (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS id) WHERE a = id OR b = id GROUP BY ALL) "
)


@query("temporal_consistency", TC + f"SELECT t, round(avg({_iou('inter', 'na', 'nb')}), 6) AS tc, count(*) AS ids FROM i GROUP BY t")
def _(spark, d):
    votes = pixels(spark, d).groupBy("frame", "user_id", "k").agg(F.count("*").alias("c"))
    rasters = votes.groupBy("frame", F.col("user_id").alias("pixel")).agg(F.min(F.struct(-F.col("c"), "k"))["k"].alias("k"))
    return ev.temporal_consistency(rasters).select(F.col("t").cast("long").alias("t"), f6(F.col("tc")).alias("tc"), "ids")


@query("image_stats", PIX + " SELECT k, count(*) AS area, sum((y = 0)::INT + (y = 49)::INT + (x = 0)::INT + (x = 49)::INT)::BIGINT AS border, count(DISTINCT frame) AS frames FROM pixels GROUP BY k")
def _(spark, d):
    return ev.image_stats(pixels(spark, d), 50, 50)


@query("visibility_correlation", COUNTS + ", p AS (SELECT x.k AS a, y.k AS b, x.pred AS va, y.pred AS vb FROM counts x JOIN counts y ON x.frame = y.frame AND x.k < y.k) SELECT a, b, round(CASE WHEN stddev_pop(va) <= 1e-9 OR stddev_pop(vb) <= 1e-9 THEN 0 ELSE covar_pop(va, vb) / (stddev_pop(va) * stddev_pop(vb)) END, 6) AS corr FROM p GROUP BY a, b")
def _(spark, d):
    return ev.visibility_correlation(ev.frame_counts(pixels(spark, d))).withColumn("corr", f6(F.col("corr")))


@query("value_percentiles", PIX + " SELECT k, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.85), 6) AS p85, round(quantile_cont(value, 0.95), 6) AS p95 FROM pixels GROUP BY k")
def _(spark, d):
    return pixels(spark, d).groupBy("k").agg(*(f6(F.percentile("value", F.lit(p / 100))).alias(f"p{p}") for p in (5, 85, 95)))


@query("merged_scores", COUNTS + f", m AS (SELECT frame, (k + 1) // 2 AS merged, sum(inter) AS i, sum(pred) AS p, max(gt) AS g FROM counts GROUP BY ALL) SELECT merged, round(avg({_iou('i', 'p', 'g')}), 6) AS iou FROM m GROUP BY merged")
def _(spark, d):
    counts = ev.dense_counts(ev.frame_counts(pixels(spark, d)))
    m = counts.groupBy("frame", F.floor((F.col("k") + 1) / 2).alias("merged")).agg(F.sum("inter").alias("i"), F.sum("pred").alias("p"), F.max("gt").alias("g"))
    return m.groupBy("merged").agg(f6(F.avg(iou(F.col("i"), F.col("p"), F.col("g")))).alias("iou"))


CUTS = [1, 2, 3, 4]


@query(
    "cached_sweep",
    PIX + f", u AS (SELECT user_id % 3 AS scene, cut, frame, count(*) FILTER (gt AND k <= cut) AS i, count(*) FILTER (k <= cut) AS p, count(*) FILTER (gt) AS g FROM pixels, (SELECT unnest({CUTS})::BIGINT AS cut) GROUP BY ALL) "
    f"SELECT scene, cut, round(avg({_iou('i', 'p', 'g')}), 6) AS iou, count(*) AS frames FROM u GROUP BY scene, cut",
)
def _(spark, d):
    """The mean IoU of the first clusters by scene and cut: half of the cuts are asked for first, so the rest alone is computed for all of them."""
    scenes = pixels(spark, d).withColumn("scene", F.col("user_id") % 3)
    counts = materialise(scenes.groupBy("scene", "frame", "k").agg(F.count_if("gt").alias("inter"), F.count("*").alias("pred")), "counts")

    def scores(missing):
        chosen = lambda c: F.sum(F.when(F.col("k") <= F.col("cut"), F.col(c)).otherwise(F.lit(0)))
        frames = counts.join(missing, "scene").groupBy("_key", "scene", "cut", "frame").agg(chosen("inter").alias("i"), chosen("pred").alias("p"), F.sum("inter").alias("g"))
        return frames.groupBy("_key", "scene", "cut").agg(f6(F.avg(iou(F.col("i"), F.col("p"), F.col("g")))).alias("iou"), F.count("*").alias("frames"))

    asked = lambda cuts: counts.select("scene").distinct().select("scene", F.explode(F.array(*map(F.lit, cuts)).cast("array<bigint>")).alias("cut"))
    path = new_path(spark, "sweep")
    sweeps.cached(path, asked(CUTS[:2]), counts, "scene", scores)
    return sweeps.cached(path, asked(CUTS), counts, "scene", scores)


@query("confusion_classes", PIX + " SELECT frame, CASE WHEN k IN (1, 3) AND gt THEN 'TP' WHEN k IN (1, 3) THEN 'FP' WHEN gt THEN 'FN' ELSE 'TN' END AS kind, count(*) AS n FROM pixels GROUP BY ALL")
def _(spark, d):
    return ev.confusion(pixels(spark, d), [1, 3])


RASTER = PIX + ", g AS (SELECT user_id % 3 AS plane, y, x, min(k) AS k FROM pixels GROUP BY ALL)"


@query("boundary_pixels", RASTER + ", l AS (SELECT *, lag(k) OVER (PARTITION BY plane, y ORDER BY x) AS w, lag(k) OVER (PARTITION BY plane, x ORDER BY y) AS n FROM g) SELECT plane, count(*) AS pixels, count(*) FILTER (coalesce(w <> k, false) OR coalesce(n <> k, false)) AS boundary FROM l GROUP BY plane")
def _(spark, d):
    g = pixels(spark, d).groupBy((F.col("user_id") % 3).alias("plane"), "y", "x").agg(F.min("k").alias("k"))
    w, n = F.lag("k").over(Window.partitionBy("plane", "y").orderBy("x")), F.lag("k").over(Window.partitionBy("plane", "x").orderBy("y"))
    edge = F.coalesce(w != F.col("k"), F.lit(False)) | F.coalesce(n != F.col("k"), F.lit(False))
    return g.withColumn("edge", edge).groupBy("plane").agg(F.count("*").alias("pixels"), F.count_if("edge").alias("boundary"))


@query("bincount_zero_filled", PIX + " SELECT b.bin, count(p.k) AS n FROM (SELECT unnest(range(0, 9))::BIGINT AS bin) b LEFT JOIN pixels p ON p.k = b.bin GROUP BY b.bin")
def _(spark, d):
    counts = pixels(spark, d).groupBy("k").agg(F.count("*").alias("n"))
    return spark.range(0, 9).withColumnRenamed("id", "bin").join(counts, F.col("bin") == F.col("k"), "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("sizes_descending", PIX + ", n AS (SELECT k, count(*) AS c FROM pixels GROUP BY k) SELECT row_number() OVER (ORDER BY c DESC, k) AS rank, k, c AS size FROM n")
def _(spark, d):
    n = pixels(spark, d).groupBy("k").agg(F.count("*").alias("size"))
    return n.select(F.row_number().over(Window.orderBy(F.col("size").desc(), "k")).cast("long").alias("rank"), "k", "size")


@query("frame_extremes", COUNTS + f", s AS (SELECT k, {_iou('inter', 'pred', 'gt')} AS iou FROM counts) SELECT k, round(min(iou), 6) AS low, round(max(iou), 6) AS high, round(avg(iou), 6) AS mean FROM s GROUP BY k")
def _(spark, d):
    s = ev.dense_counts(ev.frame_counts(pixels(spark, d))).withColumn("iou", iou(F.col("inter"), F.col("pred"), F.col("gt")))
    per_cluster = s.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("frame", "iou"))).alias("by_frame"))
    v = F.map_values("by_frame")
    return per_cluster.select("k", f6(F.array_min(v)).alias("low"), f6(F.array_max(v)).alias("high"), f6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).alias("mean"))


@query("clipped_ids", PIX + " SELECT least(k, 3) AS k, count(*) AS n FROM pixels GROUP BY ALL")
def _(spark, d):
    return pixels(spark, d).groupBy(F.least("k", F.lit(3).cast("long")).alias("k")).agg(F.count("*").alias("n"))


FRAMES = "f AS (SELECT DISTINCT doc_id AS fid FROM labels), p AS (SELECT DISTINCT doc_id AS pid FROM documents WHERE doc_id % 3 <> 0)"


@query("frame_tolerance_join", f"WITH {FRAMES} SELECT fid, pid FROM f JOIN p ON pid BETWEEN fid - 1 AND fid + 1 QUALIFY row_number() OVER (PARTITION BY fid ORDER BY CASE pid - fid WHEN -1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) = 1")
def _(spark, d):
    f = table(spark, d, "labels").select(F.col("doc_id").alias("fid")).distinct()
    p = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("pid")).distinct()
    tries = f.select("fid", F.posexplode(F.array(F.col("fid") - 1, F.col("fid"), F.col("fid") + 1)).alias("rank", "key"))
    return tries.join(p, F.col("key") == F.col("pid")).groupBy("fid").agg(F.min(F.struct("rank", "pid"))["pid"].alias("pid"))


@query("frame_alignment", "WITH g AS (SELECT DISTINCT doc_id AS g FROM labels), p AS (SELECT DISTINCT doc_id AS p FROM documents WHERE doc_id % 2 = 0), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM (SELECT DISTINCT doc_id FROM documents)), "
    "c AS (SELECT 0 AS priority, 'direct' AS method, g, g AS t FROM g UNION ALL SELECT 1, 'indexed', g, doc_id FROM g JOIN o ON pos = g * 2 UNION ALL SELECT 2, 'strided', g, doc_id FROM g JOIN o ON pos = g * 4 + 2) "
    "SELECT method, count(p) AS matched, count(*) AS tried FROM c LEFT JOIN p ON p = t GROUP BY priority, method ORDER BY matched DESC, priority LIMIT 1")  # fmt: skip
def _(spark, d):
    g = table(spark, d, "labels").select(F.col("doc_id").alias("g")).distinct()
    docs = table(spark, d, "documents").select("doc_id").distinct()
    p = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("p"))
    at = positions(docs, ["doc_id"])
    direct = g.select(F.lit(0).alias("priority"), F.lit("direct").alias("method"), "g", F.col("g").alias("t"))
    indexed = g.join(at, F.col("at") == F.col("g") * 2).select(F.lit(1), F.lit("indexed"), "g", "doc_id")
    strided = g.join(at, F.col("at") == F.col("g") * 4 + 2).select(F.lit(2), F.lit("strided"), "g", "doc_id")
    tried = direct.union(indexed).union(strided).join(p, F.col("p") == F.col("t"), "left")
    return tried.groupBy("priority", "method").agg(F.count("p").alias("matched"), F.count("*").alias("tried")).orderBy(F.col("matched").desc(), "priority").limit(1).drop("priority")


@query("positional_zip", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), w AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) SELECT a.conv_id, a.turn, w.role FROM a JOIN w USING (conv_id, i)")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    zipped = c.select("conv_id", F.explode(F.arrays_zip(F.col("t.turn").alias("turn"), F.reverse(F.col("t.role")).alias("role"))).alias("z"))
    return zipped.select("conv_id", "z.turn", "z.role")


@query("strided_sample", "WITH v AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey FROM v WHERE pos % greatest(1, n // 4) = 0 AND pos // greatest(1, n // 4) < 4")
def _(spark, d):
    w = Window.partitionBy("c_nationkey")
    v = table(spark, d, "customer").select("c_custkey", (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("at"), F.count("*").over(w).alias("n"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    return v.where((F.col("at") % stride == 0) & (F.floor(F.col("at") / stride) < 4)).select("c_custkey")


@query("positional_slices", "WITH v AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier) SELECT s_suppkey, CASE pos % 4 WHEN 0 THEN 'train' WHEN 2 THEN 'val' END AS part FROM v WHERE pos % 4 IN (0, 2)")
def _(spark, d):
    at = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    v = table(spark, d, "supplier").select("s_suppkey", (at % 4).alias("c"))
    return v.where("c IN (0, 2)").select("s_suppkey", F.when(F.col("c") == 0, "train").otherwise("val").alias("part"))


@query("hold_out_split", "SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1) % 8 = 0 AS held FROM part")
def _(spark, d):
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")) - 1
    return table(spark, d, "part").select("p_partkey", (at % 8 == 0).alias("held"))


@query("image_error", PIX + " SELECT k, round(avg(pow(value - 20, 2)), 4) AS mse, round(20 * log10(1 / sqrt(avg(pow(value - 20, 2)))), 6) AS psnr, round(avg(abs(value - 20)), 6) AS l1, round(sum(CASE WHEN gt THEN abs(value - 20) ELSE 0 END) / count(*) FILTER (gt), 6) AS masked_l1 FROM pixels GROUP BY k")
def _(spark, d):
    e = F.col("value") - 20
    p = pixels(spark, d).groupBy("k").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("l1"), F.sum(F.when(F.col("gt"), F.abs(e)).otherwise(0.0)).alias("s"), F.count_if("gt").alias("n"))
    return p.select("k", F.round("mse", 4).alias("mse"), f6(20 * F.log10(1 / F.sqrt("mse"))).alias("psnr"), f6(F.col("l1")).alias("l1"), f6(ratio(F.col("s"), F.col("n"))).alias("masked_l1"))


@query("any_over_stack", PIX + " SELECT frame, y, bool_or(gt) AS fg, max(value) AS peak FROM pixels GROUP BY ALL")
def _(spark, d):
    return pixels(spark, d).groupBy("frame", "y").agg(F.bool_or("gt").alias("fg"), F.max("value").alias("peak"))


UNIFORM = "('0x' || substr(md5({key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


@query("co_mask_pairs", PIX + ", n AS (SELECT count(DISTINCT user_id) AS n FROM pixels), m AS (SELECT DISTINCT frame, user_id AS u, k FROM pixels, n WHERE " + UNIFORM.format(key="user_id::VARCHAR") + " < 100.0 / n) SELECT a.u AS a, b.u AS b, count(*) AS shared FROM m a JOIN m b ON a.frame = b.frame AND a.k = b.k AND a.u < b.u GROUP BY ALL")
def _(spark, d):
    """How many masks, over all frames, each two of about 100 sampled pixels share."""
    p = pixels(spark, d)
    sampled = ev.sampled_keys(p, "user_id", 100)
    m = p.join(sampled, "user_id", "left_semi").select("frame", F.col("user_id").alias("u"), "k").distinct()
    a, b = m.select("frame", "k", F.col("u").alias("a")), m.select("frame", "k", F.col("u").alias("b"))
    return a.join(b, ["frame", "k"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
