"""Queries of cluster likeness, merge proposals, greedy unions and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions.safe import f6, iou
from gneiss.operators import affinity as af
from gneiss.operators import evaluation as ev
from gneiss.operators import proposals as pr
from gneiss.operators import raster as rs
from gneiss.operators import solvers as sv
from gneiss.plans.carriers import SQL, pixels, primitives
from gneiss.plans.evaluation import COUNTS
from gneiss.plans.graph import WEIGHTED, weighted_edges
from gneiss.plans.solving import IMG, SOBEL, images

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PRIM = f"WITH {SQL['prim']}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


SIM = (
    PRIM + ", m AS (SELECT label, i, avg(e[14 + i]) AS v FROM prim, (SELECT unnest(range(1, 19)) AS i) GROUP BY ALL), z AS (SELECT label, i, v - avg(v) OVER (PARTITION BY label) AS v FROM m), "
    "f AS (SELECT label, i, avg(e[56 + i]) AS v FROM prim, (SELECT unnest(range(1, 9)) AS i) GROUP BY ALL), "
    "n AS (SELECT label, count(*) AS n, avg(e[4]) AS c1, avg(e[5]) AS c2, avg(e[6]) AS c3 FROM prim GROUP BY label), "
    "zn AS (SELECT label, sqrt(sum(v * v)) AS r FROM z GROUP BY label), fn AS (SELECT label, sqrt(sum(v * v)) AS r FROM f GROUP BY label), "
    "zz AS (SELECT a.label AS a, b.label AS b, sum(a.v * b.v) AS d FROM z a JOIN z b ON a.i = b.i AND a.label < b.label GROUP BY ALL), ff AS (SELECT a.label AS a, b.label AS b, sum(a.v * b.v) AS d FROM f a JOIN f b ON a.i = b.i AND a.label < b.label GROUP BY ALL), "
    "w AS (SELECT wt / (wt + 0.3 + 0.2) AS wt, 0.3 / (wt + 0.3 + 0.2) AS wf, 0.2 / (wt + 0.3 + 0.2) AS wc FROM (SELECT CASE WHEN max(r) > 1e-6 THEN 0.7 ELSE 0 END AS wt FROM zn)), "
    "parts AS (SELECT zz.a, zz.b, zz.d / (greatest(x.r, 1e-12) * greatest(y.r, 1e-12)) AS traj, ff.d / (greatest(p.r, 1e-12) * greatest(q.r, 1e-12)) AS feat, exp(-(pow(i.c1 - j.c1, 2) + pow(i.c2 - j.c2, 2) + pow(i.c3 - j.c3, 2)) / (2 * 0.1 * 0.1)) AS color, least(i.n, j.n) AS n "
    "FROM zz JOIN ff USING (a, b) JOIN zn x ON x.label = zz.a JOIN zn y ON y.label = zz.b JOIN fn p ON p.label = zz.a JOIN fn q ON q.label = zz.b JOIN n i ON i.label = zz.a JOIN n j ON j.label = zz.b)"
)


@query("cluster_likeness", SIM + " SELECT a, b, round(traj, 6) AS traj, round(feat, 6) AS feat, round(color, 6) AS color, round(CASE WHEN n >= 40 THEN wt * traj + wf * feat + wc * color ELSE 0 END, 6) AS s FROM parts, w")
def _(spark, d):
    s = pr.similarity(primitives(spark, d), "label", (0.7, 0.3, 0.2), 0.1, least_size=40)
    return s.select("a", "b", *(f6(F.col(c)).alias(c) for c in ("traj", "feat", "color", "s")))


@query("kept_clusters", PRIM + " SELECT label, count(*) AS size, count(*) >= 50 AS kept FROM prim WHERE label > 0 GROUP BY label")
def _(spark, d):
    sizes = primitives(spark, d).where("label > 0").groupBy("label").agg(F.count("*").alias("size"))
    return sizes.withColumn("kept", F.col("size") >= 50)


OBJECTS = (
    f"WITH {SQL['prim']}, {SQL['pixels']}, o AS (SELECT user_id % 10 + 1 AS id, * FROM pixels), tot AS (SELECT count(*) AS n FROM pixels), "
    "st AS (SELECT id, count(*) AS area, sum((y = 0)::INT + (y = 49)::INT + (x = 0)::INT + (x = 49)::INT) AS border FROM o GROUP BY id), mo AS (SELECT label AS id, avg(abs(e[15])) AS motion FROM prim GROUP BY label), "
    "q AS (SELECT quantile_cont(motion, 0.05) AS p5, quantile_cont(motion, 0.85) AS p85 FROM st JOIN mo USING (id)), "
    "ob AS (SELECT id, area, (0.2 + 0.8 * greatest(0, least(1, (motion - p5) / greatest(p85 - p5, 1e-9)))) * (1 - exp(-(area::DOUBLE / n) / 0.05)) * exp(-(border::DOUBLE / area) / 0.1) * exp(-greatest(area::DOUBLE / n - 0.09, 0) / 0.1) AS o, n FROM st JOIN mo USING (id), q, tot)"
)


def _objects(spark, d):
    """Clusters ``(id, area, border, motion, total)`` seen as the pixels of every tenth user."""
    seen = pixels(spark, d).withColumn("id", (F.col("user_id") % 10 + 1).cast("int"))
    edge = sum((F.when(c, 1).otherwise(0) for c in (F.col("y") == 49, F.col("x") == 0, F.col("x") == 49)), F.when(F.col("y") == 0, 1).otherwise(0))
    stats = seen.groupBy("id").agg(F.count("*").alias("area"), F.sum(edge).alias("border"))
    motion = primitives(spark, d).groupBy(F.col("label").alias("id")).agg(F.avg(F.abs(F.get("traj", 0))).alias("motion"))
    total = stats.agg(F.sum("area").alias("total"))
    return seen, stats.join(motion, "id").crossJoin(F.broadcast(total))  # one row


def _scored(spark, d):
    seen, stats = _objects(spark, d)
    return seen, pr.objectness(stats, "motion", "area", "border", F.col("total"), 0.1, 0.05, 0.09).select(F.col("id").cast("long").alias("id"), "objectness", "area", "total")


@query("objectness", OBJECTS + " SELECT id, round(o, 6) AS objectness FROM ob")
def _(spark, d):
    return _scored(spark, d)[1].select("id", f6(F.col("objectness")).alias("objectness"))


NEAR = (
    OBJECTS + "," + SIM.removeprefix(PRIM + ",")
    + ", fr AS (SELECT DISTINCT frame FROM pixels), va AS (SELECT fr.frame, c.id, count(o.id) AS v FROM fr CROSS JOIN (SELECT DISTINCT id FROM o) c LEFT JOIN o ON o.frame = fr.frame AND o.id = c.id GROUP BY ALL), "
    "co AS (SELECT x.id AS a, y.id AS b, CASE WHEN stddev_pop(x.v) <= 1e-9 OR stddev_pop(y.v) <= 1e-9 THEN 0 ELSE covar_pop(x.v, y.v) / (stddev_pop(x.v) * stddev_pop(y.v)) END AS corr FROM va x JOIN va y ON x.frame = y.frame AND x.id < y.id GROUP BY ALL), "
    "pp AS (SELECT a, b, traj, 0.7 * traj + 0.3 * color AS pair, corr FROM parts JOIN co USING (a, b)), bw AS (SELECT * FROM pp UNION ALL SELECT b, a, traj, pair, corr FROM pp), "
    "sd AS (SELECT * FROM (SELECT * FROM ob ORDER BY o DESC, id LIMIT 6) WHERE o >= 0.05), "
    "nb AS (SELECT bw.a AS seed, bw.b AS other, pair + 0.5 * (sd.o + x.o) / 2 + 0.2 * greatest(0, 0.4 - corr) AS score FROM bw JOIN sd ON sd.id = bw.a JOIN ob x ON x.id = bw.b WHERE x.o >= 0.02 AND traj >= -0.3 AND pair >= -0.2 AND corr <= 0.4 AND (sd.area + x.area)::DOUBLE / x.n <= 0.3)"
)
RULES = dict(most_seeds=6, least_seed=0.05, least_member=0.02, least_traj=-0.3, tau=-0.2, most_corr=0.4, most_area=0.3, by_objectness=0.5, by_visibility=0.2)


def _pairs(spark, d):
    """``(a, b, traj, pair, corr)`` of clusters, the clusters, and the number of pixels."""
    seen, scored = _scored(spark, d)
    parts = pr.similarity(primitives(spark, d), "label", (0.7, 0.3, 0.2), 0.1)
    corr = ev.visibility_correlation(ev.frame_counts(seen.drop("k").withColumnRenamed("id", "k")))
    pairs = parts.join(corr, ["a", "b"]).select(F.col("a").cast("long"), F.col("b").cast("long"), "traj", (0.7 * F.col("traj") + 0.3 * F.col("color")).alias("pair"), "corr")
    return pairs, scored.drop("total"), float(scored.agg(F.max("total")).first()[0] or 0)


@query("seed_neighbours", NEAR + " SELECT seed::BIGINT AS seed, other::BIGINT AS other, round(score, 6) AS score, row_number() OVER (PARTITION BY seed ORDER BY round(score, 12) DESC, other) AS rank FROM nb QUALIFY rank <= 4")
def _(spark, d):
    near = pr.seed_neighbours(*_pairs(spark, d), **RULES).where("rank <= 4")
    return near.select("seed", "other", f6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("component_proposals")
def _(spark, d):
    groups = pr.component_proposals(*_pairs(spark, d), top=3, most_members=3, most_components=3, **RULES)
    return groups.select("component", "id", f6(F.col("score")).alias("score"))


@query("component_ids", OBJECTS + ", g AS (SELECT id, CASE WHEN id IN (3, 7) THEN 0 WHEN id IN (2, 5, 9) THEN 1 END AS component FROM ob) SELECT id, dense_rank() OVER (ORDER BY component NULLS LAST, CASE WHEN component IS NULL THEN id END) - 1 AS merged FROM g")
def _(spark, d):
    clusters = _scored(spark, d)[1]
    named = F.when(F.col("id").isin(3, 7), 0).when(F.col("id").isin(2, 5, 9), 1)
    return pr.component_ids(clusters, clusters.select("id", named.alias("component")).where("component IS NOT NULL"))


@query("single_component")
def _(spark, d):
    best = pr.single_component(*_pairs(spark, d), most_seeds=6, least_seed=0.05, least_member=0.02, least_traj=-0.3, tau=-0.2, most_members=4, most_area=0.4, target_area=0.2, by_objectness=0.5)
    return best.select("seed", F.explode("members").alias("id"), f6(F.col("score")).alias("score"))


def _greedy(start: str, margin: str, value: str = "") -> str:
    pooled = "(u.i + t.i)::DOUBLE / nullif(u.p + t.p + g.gt - u.i - t.i, 0)"
    return (
        COUNTS.replace("WITH", "WITH RECURSIVE", 1) + ", t AS (SELECT k, sum(inter)::BIGINT AS i, sum(pred)::BIGINT AS p FROM counts GROUP BY k), g AS (SELECT sum(gt)::BIGINT AS gt FROM fr), "
        f"u(step, ks, i, p, score) AS (SELECT 0, []::BIGINT[], 0::BIGINT, 0::BIGINT, {start}::DOUBLE UNION ALL SELECT step, ks, i, p, score FROM (SELECT u.step + 1 AS step, list_append(u.ks, t.k) AS ks, u.i + t.i AS i, u.p + t.p AS p, coalesce({pooled}, 0) AS score, u.score AS old FROM u, t, g "
        f"WHERE NOT list_contains(u.ks, t.k) QUALIFY row_number() OVER (ORDER BY coalesce({pooled}, 0) DESC, t.k) = 1) WHERE score > old + {margin}) SELECT (step - 1)::BIGINT AS rank, ks[step] AS k, round(score, 6) AS score FROM u WHERE step > 0"
    )


def _totals(spark, d):
    counts = ev.frame_counts(pixels(spark, d))
    gt = counts.select("frame", "gt").distinct().agg(F.sum("gt").alias("all_gt"))
    return ev.dense_counts(counts).groupBy("k").agg(F.sum("inter").alias("inter"), F.sum("pred").alias("pred")).crossJoin(F.broadcast(gt))  # one row


@query("greedy_union", _greedy("-1.0", "0"))
def _(spark, d):
    """Clusters in the order in which the pooled greedy union takes them, from the best one on."""
    return pr.greedy_union(_totals(spark, d), F.max("all_gt")).withColumn("score", f6(F.col("score")))


@query("greedy_union_from_empty", _greedy("0", "1e-12"))
def _(spark, d):
    return pr.greedy_union(_totals(spark, d), F.max("all_gt"), 1e-12, from_empty=True).withColumn("score", f6(F.col("score")))


_MEAN = "avg(CASE WHEN p + gt - i = 0 THEN 0 ELSE i::DOUBLE / (p + gt - i) END)"
BY_FRAMES = (
    COUNTS.replace("WITH", "WITH RECURSIVE", 1) + ", ks AS (SELECT DISTINCT k FROM counts), u(step, ks, score) AS (SELECT 0, []::BIGINT[], -2.0::DOUBLE UNION ALL SELECT step, ks, score FROM (SELECT step + 1 AS step, list_append(ks, k) AS ks, score, old FROM ("
    f"SELECT step, ks, k, old, {_MEAN} AS score FROM (SELECT u.step, u.ks, u.score AS old, ks.k, c.frame, sum(c.inter) AS i, sum(c.pred) AS p, any_value(c.gt) AS gt FROM u, ks, counts c WHERE NOT list_contains(u.ks, ks.k) AND (c.k = ks.k OR list_contains(u.ks, c.k)) GROUP BY ALL) GROUP BY step, ks, k, old"
    ") QUALIFY row_number() OVER (ORDER BY round(score, 12) DESC, k) = 1) WHERE score > old + 1e-12) SELECT (step - 1)::BIGINT AS rank, ks[step] AS k, round(score, 6) AS score FROM u WHERE step > 0"
)


@query("greedy_union_by_frames", BY_FRAMES)
def _(spark, d):
    dense = ev.dense_counts(ev.frame_counts(pixels(spark, d)))
    return pr.greedy_union_by_frames(dense).withColumn("score", f6(F.col("score")))


# Five clusters against seven objects a frame: every way to give the clusters different objects is tried.
MATCHES = (
    f"WITH {SQL['pixels']}, p AS (SELECT frame, k, count(*) AS pred FROM pixels GROUP BY ALL), g AS (SELECT frame, user_id % 7 AS object, count(*) FILTER (gt) AS gt FROM pixels GROUP BY ALL), c AS (SELECT frame, k, user_id % 7 AS object, count(*) FILTER (gt) AS inter FROM pixels GROUP BY ALL), "
) + (
    "ks AS (SELECT unnest(range(1, 6)) AS k), m AS (SELECT g.frame, ks.k, g.object, coalesce(inter::DOUBLE / nullif(coalesce(pred, 0) + gt - coalesce(inter, 0), 0), 0) AS iou FROM g CROSS JOIN ks LEFT JOIN p ON p.frame = g.frame AND p.k = ks.k LEFT JOIN c ON c.frame = g.frame AND c.k = ks.k AND c.object = g.object), "
    "best AS (SELECT m1.frame, max(m1.iou + m2.iou + m3.iou + m4.iou + m5.iou) AS total FROM m m1 " + " ".join(f"JOIN m m{i} ON m{i}.frame = m1.frame AND m{i}.k = {i}" + "".join(f" AND m{i}.object <> m{j}.object" for j in range(1, i)) for i in range(2, 6)) + " WHERE m1.k = 1 GROUP BY m1.frame) "
    "SELECT frame, round(total / 5, 6) AS matched_mean, round(total / n, 6) AS object_mean FROM best JOIN (SELECT frame, count(*) AS n FROM g GROUP BY frame) USING (frame)"
)


@query("matching_means", MATCHES)
def _(spark, d):
    """Per frame, the mean IoU of one-to-one matches: over matched pairs, and over all objects."""
    p = pixels(spark, d)
    pred = p.groupBy("frame", "k").agg(F.count("*").alias("pred"))
    gt = p.groupBy("frame", (F.col("user_id") % 7).alias("object")).agg(F.count_if("gt").alias("gt"))
    inter = p.groupBy("frame", "k", (F.col("user_id") % 7).alias("object")).agg(F.count_if("gt").alias("inter"))
    grid = gt.crossJoin(F.broadcast(spark.range(1, 6).withColumnRenamed("id", "k")))  # the five clusters
    matrix = grid.join(pred, ["frame", "k"], "left").join(inter, ["frame", "k", "object"], "left").fillna(0, ["pred", "inter"])
    matched = sv.match_one_to_one(matrix.withColumn("iou", iou(F.col("inter"), F.col("pred"), F.col("gt"))), "frame")
    objects = gt.groupBy("frame").agg(F.count("*").alias("objects"))
    means = matched.groupBy("frame").agg(F.sum("iou").alias("total"), F.count("*").alias("pairs")).join(objects, "frame")
    return means.select("frame", f6(F.col("total") / F.col("pairs")).alias("matched_mean"), f6(F.col("total") / F.col("objects")).alias("object_mean"))


# Boundaries: three images are the views; points fall on them by turning about the vertical axis.
_PX = "25 + 60 * ({e}[1] * cos(view) + {e}[3] * sin(view))"
BOUND = (
    WEIGHTED + "," + IMG.removeprefix("WITH ") + SOBEL + ", sob AS (SELECT plane, y, x, sqrt(gx.g * gx.g + gy.g * gy.g) AS s FROM gx JOIN gy USING (plane, y, x)), "
    "ps AS (SELECT plane, quantile_cont(s, 0.95) AS top FROM sob GROUP BY plane), pv AS (SELECT plane, quantile_cont(v, 0.95) AS top FROM img GROUP BY plane), "
    "maps AS (SELECT plane AS view, y, x, least(1, greatest(0, s / greatest(ps.top, 1e-8))) AS gd, least(1, greatest(0, img.v / greatest(pv.top, 1e-8))) AS gc FROM sob JOIN img USING (plane, y, x) JOIN ps USING (plane) JOIN pv USING (plane)), "
    f"px AS (SELECT id, view, {_PX.format(e='e')} AS u, 25 + 60 * e[2] AS w FROM prim, (SELECT unnest(range(0, 3)) AS view)), vis AS (SELECT * FROM px WHERE u >= 0 AND u <= 49 AND w >= 0 AND w <= 49), "
    "seg AS (SELECT src, dst, i.view, i.u AS xi, i.w AS yi, j.u AS xj, j.w AS yj FROM knn JOIN vis i ON i.id = src JOIN vis j ON j.id = dst AND j.view = i.view), "
    "pt AS (SELECT src, dst, view, k, xi * (1 - k / 7) + xj * (k / 7) AS x, yi * (1 - k / 7) + yj * (k / 7) AS y FROM seg, (SELECT unnest(range(0, 8))::DOUBLE AS k)), "
    "cn AS (SELECT src, dst, pt.view, k, (CASE WHEN dx = 1 THEN pt.x - floor(pt.x) ELSE 1 - pt.x + floor(pt.x) END) * (CASE WHEN dy = 1 THEN pt.y - floor(pt.y) ELSE 1 - pt.y + floor(pt.y) END) AS wt, gd, gc FROM pt, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx) LEFT JOIN maps m ON m.view = pt.view AND m.y = floor(pt.y) + dy AND m.x = floor(pt.x) + dx), "
    "sm AS (SELECT src, dst, view, k, sum(wt * coalesce(gd, 0)) AS gd, sum(wt * coalesce(gc, 0)) AS gc FROM cn GROUP BY ALL), mx AS (SELECT src, dst, max(gd) AS gd, max(gc) AS gc FROM sm GROUP BY ALL)"
)


@query("boundary_suppression", BOUND + " SELECT src, dst, round(w, 6) AS w, round(CASE WHEN gd IS NULL THEN 0 ELSE least(0.99, 1 / (1 + exp(-(4 * gd + 2 * gc - 3)))) END, 6) AS b, round(w * (1 - CASE WHEN gd IS NULL THEN 0 ELSE least(0.99, 1 / (1 + exp(-(4 * gd + 2 * gc - 3)))) END), 6) AS held FROM edges LEFT JOIN mx USING (src, dst)")
def _(spark, d):
    """Weights held back where an edge, drawn on the views, crosses edges of depth or colour."""
    image = images(spark, d)
    sobel = rs.scaled(rs.edge_strength(image, ["plane"]), ["plane"], "edge").select("plane", "y", "x", F.col("edge").alias("gd"))
    maps = sobel.join(rs.scaled(image, ["plane"], "v"), ["plane", "y", "x"]).select(F.col("plane").alias("view"), "y", "x", "gd", F.col("v").alias("gc"))
    views = spark.range(0, 3).withColumnRenamed("id", "view")  # cameras: a fixed small table
    v = F.col("view")
    at = primitives(spark, d).crossJoin(F.broadcast(views)).select("id", "view", (25 + 60 * (F.col("x") * F.cos(v) + F.col("z") * F.sin(v))).alias("u"), (25 + 60 * F.col("y")).alias("w"))
    at = at.where("u BETWEEN 0 AND 49 AND w BETWEEN 0 AND 49")
    edges = weighted_edges(spark, d)
    ends = edges.join(at.select(F.col("id").alias("src"), "view", F.col("u").alias("xi"), F.col("w").alias("yi")), "src")
    ends = ends.join(at.select(F.col("id").alias("dst"), "view", F.col("u").alias("xj"), F.col("w").alias("yj")), ["dst", "view"])
    most = af.segment_max(ends.drop("w"), maps, ["src", "dst"], "view", ["gd", "gc"], 8)
    held = edges.join(most, ["src", "dst"], "left").withColumn("b", af.boundary(F.col("gd"), F.col("gc"), F.col("gd").isNotNull(), 4.0, 2.0, 3.0))
    return held.select("src", "dst", f6(F.col("w")).alias("w"), f6(F.col("b")).alias("b"), f6(F.col("w") * (1 - F.col("b"))).alias("held"))
