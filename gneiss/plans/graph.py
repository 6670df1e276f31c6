"""Queries on point primitives and their graphs; ``embeddings`` carries the points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions.safe import dot, f6, norm, sigmoid
from gneiss.operators import affinity as af
from gneiss.operators import clusters as cl
from gneiss.operators.components import connected_components
from gneiss.plans.carriers import SQL, primitives

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PRIM = f"WITH {SQL['prim']}"
K = 10
D2 = "(a.e[1]-b.e[1])*(a.e[1]-b.e[1]) + (a.e[2]-b.e[2])*(a.e[2]-b.e[2]) + (a.e[3]-b.e[3])*(a.e[3]-b.e[3])"
KNN = (
    PRIM + f", live AS (SELECT * FROM prim WHERE 1 / (1 + exp(-e[14])) > 0.5), "
    f"knn AS (SELECT a.id AS src, b.id AS dst, {D2} AS d2 FROM live a JOIN live b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) <= {K})"
)


def _sum(expr: str, lo: int, n: int) -> str:
    """A sum over positions lo .. lo + n - 1 of both ends, in order."""
    return "(0.0::DOUBLE + " + " + ".join(expr.format(i=i) for i in range(lo, lo + n)) + ")"


COLOR = f"exp(-{_sum('(a.e[{i}]-b.e[{i}])*(a.e[{i}]-b.e[{i}])', 4, 3)} / (2 * 0.8 * 0.8))"
NORM = lambda t: f"sqrt({_sum(t + '.e[{i}]*' + t + '.e[{i}]', 7, 3)})"
SCALE = f"exp(-pow(ln(greatest({NORM('a')}, 1e-6) / greatest({NORM('b')}, 1e-6)), 2) / (2 * 0.5 * 0.5))"
def _q(i: int) -> str:
    n = "sqrt(" + _sum("e[{i}]*e[{i}]", 10, 4) + ")"
    return f"(e[{10 + i}] / {n})"


ROT = [
    ["1 - 2*({y}*{y} + {z}*{z})", "2*({x}*{y} - {w}*{z})", "2*({x}*{z} + {w}*{y})"],
    ["2*({x}*{y} + {w}*{z})", "1 - 2*({x}*{x} + {z}*{z})", "2*({y}*{z} - {w}*{x})"],
    ["2*({x}*{z} - {w}*{y})", "2*({y}*{z} + {w}*{x})", "1 - 2*({x}*{x} + {y}*{y})"],
]
ROTATED = PRIM + ", q AS (SELECT id, e, " + ", ".join(f"{_q(i)} AS {c}" for i, c in enumerate(("qw", "qx", "qy", "qz"))) + " FROM prim), r AS (SELECT id, e, " + ", ".join(
    f"{ROT[a][b].format(w='qw', x='qx', y='qy', z='qz')} AS r{a}{b}" for a in range(3) for b in range(3)
) + " FROM q)"
AXIS = ROTATED + ", ax AS (SELECT id, list_position(e[7:9], list_max(e[7:9])) AS m, * EXCLUDE (id) FROM r), v AS (SELECT id, " + ", ".join(f"[r{a}0, r{a}1, r{a}2][m] AS v{a}" for a in range(3)) + " FROM ax)"
ORIENT = "abs(i.v0*j.v0 + i.v1*j.v1 + i.v2*j.v2)"
WEIGHTED = KNN + "," + AXIS.removeprefix(PRIM + ",") + f", edges AS (SELECT src, dst, pow({COLOR} * {ORIENT} * {SCALE}, 1.0::DOUBLE / 3) AS w FROM knn JOIN prim a ON a.id = src JOIN prim b ON b.id = dst JOIN v i ON i.id = src JOIN v j ON j.id = dst)"
SYM = WEIGHTED + ", sym AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges) GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def live(spark, d):
    """Points whose opacity passes the filter."""
    return primitives(spark, d).where(sigmoid(F.col("opacity")) > 0.5)


def knn_edges(spark, d):
    return af.nearest(live(spark, d), K)


def weighted_edges(spark, d):
    """Edges weighted by likeness of colour, orientation and scale."""
    points = primitives(spark, d).select("id", "f_dc", "scale", af.principal_axis(F.col("scale"), F.col("rot")).alias("v"))
    ends = af.gather(knn_edges(spark, d).select("src", "dst"), points, ["f_dc", "scale", "v"])
    color = af.gaussian(af.square_distance(F.col("f_dc_i"), F.col("f_dc_j")), 0.8)
    return ends.select("src", "dst", af.fused(color, F.abs(dot(F.col("v_i"), F.col("v_j"))), af.scale_affinity(F.col("scale_i"), F.col("scale_j"), 0.5)).alias("w"))


@query("opacity_filter", PRIM + " SELECT id, round(1 / (1 + exp(-e[14])), 6) AS opacity FROM prim WHERE 1 / (1 + exp(-e[14])) > 0.5")
def _(spark, d):
    return live(spark, d).select("id", f6(sigmoid(F.col("opacity"))).alias("opacity"))


@query("knn_topk", KNN + " SELECT src, dst, round(d2, 9) AS d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM knn")
def _(spark, d):
    return knn_edges(spark, d).select("src", "dst", F.round("d2", 9).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query("knn_label_transfer", PRIM + f", lab AS (SELECT * FROM prim WHERE id % 2 = 0) SELECT a.id, arg_min(b.label, ({D2}, b.id)) AS label FROM prim a JOIN lab b ON a.id <> b.id WHERE a.id % 2 = 1 GROUP BY a.id")
def _(spark, d):
    p = primitives(spark, d)
    seeds = p.where("id % 2 = 0")
    near = af.nearest(p.where("id % 2 = 1"), 1, seeds)
    return near.join(seeds.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label")


@query("neighbour_feature_mean", KNN + ", f AS (SELECT src, dst FROM knn UNION ALL SELECT id, id FROM live) SELECT src AS id, round(avg(b.e[57]), 6) AS f0, round(avg(b.e[64]), 6) AS f7, count(*) AS n FROM f JOIN prim b ON b.id = dst GROUP BY src")
def _(spark, d):
    own = live(spark, d).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    feats = primitives(spark, d).select(F.col("id").alias("dst"), "feats")
    joined = knn_edges(spark, d).select("src", "dst").union(own).join(feats, "dst")
    return joined.groupBy(F.col("src").alias("id")).agg(f6(F.avg(F.get("feats", 0))).alias("f0"), f6(F.avg(F.get("feats", 7))).alias("f7"), F.count("*").alias("n"))


@query("color_affinity", KNN + f" SELECT src, dst, round({COLOR}, 6) AS w FROM knn JOIN prim a ON a.id = src JOIN prim b ON b.id = dst")
def _(spark, d):
    ends = af.gather(knn_edges(spark, d).select("src", "dst"), primitives(spark, d), ["f_dc"])
    return ends.select("src", "dst", f6(af.gaussian(af.square_distance(F.col("f_dc_i"), F.col("f_dc_j")), 0.8)).alias("w"))


@query("scale_affinity", KNN + f" SELECT src, dst, round({SCALE}, 6) AS w FROM knn JOIN prim a ON a.id = src JOIN prim b ON b.id = dst")
def _(spark, d):
    ends = af.gather(knn_edges(spark, d).select("src", "dst"), primitives(spark, d), ["scale"])
    return ends.select("src", "dst", f6(af.scale_affinity(F.col("scale_i"), F.col("scale_j"), 0.5)).alias("w"))


@query("position_affinity", KNN + " SELECT src, dst, round(exp(-d2 / (2 * 0.3 * 0.3)), 6) AS w FROM knn")
def _(spark, d):
    return knn_edges(spark, d).select("src", "dst", f6(af.gaussian(F.col("d2"), 0.3)).alias("w"))


@query("quaternion_rotation", ROTATED + " SELECT id, " + ", ".join(f"round(r{a}{b}, 6) AS r{a}{b}" for a in range(3) for b in range(3)) + " FROM r")
def _(spark, d):
    r = af.rotation_rows(F.col("rot"))
    return primitives(spark, d).select("id", *(f6(r[a][b]).alias(f"r{a}{b}") for a in range(3) for b in range(3)))


@query("principal_axis", AXIS + " SELECT id, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2 FROM v")
def _(spark, d):
    v = primitives(spark, d).select("id", af.principal_axis(F.col("scale"), F.col("rot")).alias("v"))
    return v.select("id", *(f6(F.get("v", i)).alias(f"v{i}") for i in range(3)))


@query("orientation_affinity", KNN + "," + AXIS.removeprefix(PRIM + ",") + " SELECT src, dst, round(abs(i.v0*j.v0 + i.v1*j.v1 + i.v2*j.v2), 6) AS w FROM knn JOIN v i ON i.id = src JOIN v j ON j.id = dst")
def _(spark, d):
    axes = primitives(spark, d).select("id", af.principal_axis(F.col("scale"), F.col("rot")).alias("v"))
    ends = af.gather(knn_edges(spark, d).select("src", "dst"), axes, ["v"])
    return ends.select("src", "dst", f6(F.abs(dot(F.col("v_i"), F.col("v_j")))).alias("w"))


COV = lambda a, b: " + ".join(f"r{a}{k}*r{b}{k}*(exp(e[{7 + k}])*exp(e[{7 + k}]))" for k in range(3))


@query("covariance", ROTATED + " SELECT id, " + ", ".join(f"round({COV(a, b)}, 6) AS c{a}{b}" for a in range(3) for b in range(a, 3)) + " FROM r")
def _(spark, d):
    entries = af.covariance(F.transform("scale", lambda s: F.exp(s)), F.col("rot"))
    names = [f"c{a}{b}" for a in range(3) for b in range(a, 3)]
    return primitives(spark, d).select("id", *(f6(c).alias(n) for c, n in zip(entries, names, strict=True)))


CENTRED = "list_transform(range(1, 19), lambda i: e[14 + i] - (" + " + ".join(f"e[14 + {1 + 3 * t} + ((i - 1) % 3)]" for t in range(6)) + ") / 6)"
TRAJ = ", c AS (SELECT id, " + CENTRED + " AS t FROM prim), s AS (SELECT id, t, sqrt(list_sum(list_transform(t, lambda q: q * q))) AS r FROM c)"
TRAJ_W = "greatest(0, list_sum(list_transform(range(1, 19), lambda k: i.t[k] * j.t[k])) / (i.r * j.r + 1e-8))"


def trajectories(spark, d):
    c = primitives(spark, d).select("id", af.centred(F.col("traj"), 6).alias("t"))
    return c.select("id", "t", norm(F.col("t")).alias("r"))


def trajectory_edges(spark, d):
    ends = af.gather(knn_edges(spark, d).select("src", "dst"), trajectories(spark, d), ["t", "r"])
    w = F.greatest(F.lit(0.0), dot(F.col("t_i"), F.col("t_j")) / (F.col("r_i") * F.col("r_j") + 1e-8))
    return ends.select("src", "dst", w.alias("w"), "r_i", "r_j")


@query("trajectory_affinity", KNN + TRAJ + f" SELECT src, dst, round({TRAJ_W}, 6) AS w FROM knn JOIN s i ON i.id = src JOIN s j ON j.id = dst")
def _(spark, d):
    return trajectory_edges(spark, d).select("src", "dst", f6(F.col("w")).alias("w"))


@query("static_fusion", KNN + TRAJ + f" SELECT src, dst, round(CASE WHEN i.r < 0.5 AND j.r < 0.5 THEN 1 WHEN i.r < 0.5 OR j.r < 0.5 THEN 0.2 + 0.8 * {TRAJ_W} ELSE {TRAJ_W} END, 6) AS w FROM knn JOIN s i ON i.id = src JOIN s j ON j.id = dst")
def _(spark, d):
    e = trajectory_edges(spark, d)
    return e.select("src", "dst", f6(af.static_fusion(F.col("w"), F.col("r_i"), F.col("r_j"), 0.5, 0.2)).alias("w"))


ROTD = "(" + " + ".join("abs(" + " + ".join(f"a.e[{33 + 4 * t + c}]*b.e[{33 + 4 * t + c}]" for c in range(4)) + ")" for t in range(6)) + ") / 6"


@query("rotation_affinity", KNN + f" SELECT src, dst, round({ROTD}, 6) AS w FROM knn JOIN prim a ON a.id = src JOIN prim b ON b.id = dst")
def _(spark, d):
    ends = af.gather(knn_edges(spark, d).select("src", "dst"), primitives(spark, d), ["dquat"])
    part = lambda c, t: F.slice(c, 4 * t + 1, 4)
    w = sum((F.abs(dot(part("dquat_i", t), part("dquat_j", t))) for t in range(6)), F.lit(0.0)) / 6
    return ends.select("src", "dst", f6(w).alias("w"))


@query("fused_weights", WEIGHTED + " SELECT src, dst, round(w, 6) AS w, round(pow(w, 2), 6) AS sharp, 1.0::DOUBLE AS plain FROM edges")
def _(spark, d):
    w, one = F.col("w"), F.lit(1.0)
    return weighted_edges(spark, d).select("src", "dst", f6(w).alias("w"), f6(F.pow(w, F.lit(2.0))).alias("sharp"), af.fused(w, one, one, use_geometry=False).alias("plain"))


MOTION = WEIGHTED + TRAJ + f", motion AS (SELECT src, dst, {TRAJ_W} * ({ROTD}) AS m, i.r AS ri, j.r AS rj FROM knn JOIN prim a ON a.id = src JOIN prim b ON b.id = dst JOIN s i ON i.id = src JOIN s j ON j.id = dst)"


@query("motion_weights", MOTION + " SELECT src, dst, round(w * CASE WHEN ri < 0.5 AND rj < 0.5 THEN 1 WHEN ri < 0.5 OR rj < 0.5 THEN 0.2 + 0.8 * m ELSE m END, 6) AS w FROM edges JOIN motion USING (src, dst)")
def _(spark, d):
    """Weights times the likeness of motion: trajectory times rotation, with static ends taken apart."""
    points = primitives(spark, d).join(trajectories(spark, d), "id")
    ends = af.gather(weighted_edges(spark, d), points, ["t", "r", "dquat"])
    along = F.greatest(F.lit(0.0), dot(F.col("t_i"), F.col("t_j")) / (F.col("r_i") * F.col("r_j") + 1e-8))
    part = lambda c, t: F.slice(c, 4 * t + 1, 4)
    turn = sum((F.abs(dot(part("dquat_i", t), part("dquat_j", t))) for t in range(6)), F.lit(0.0)) / 6
    return ends.select("src", "dst", f6(F.col("w") * af.static_fusion(along * turn, F.col("r_i"), F.col("r_j"), 0.5, 0.2)).alias("w"))


@query("symmetrise_max", SYM + " SELECT src, dst, round(w, 6) AS w FROM sym WHERE w <> 0")
def _(spark, d):
    return af.symmetrise(weighted_edges(spark, d)).withColumn("w", f6(F.col("w")))


@query("node_degree", SYM + " SELECT src AS id, round(sum(w), 6) AS degree, count(*) AS edges FROM sym WHERE w <> 0 GROUP BY src")
def _(spark, d):
    s = af.symmetrise(weighted_edges(spark, d))
    return s.groupBy(F.col("src").alias("id")).agg(f6(F.sum("w")).alias("degree"), F.count("*").alias("edges"))


@query("normalised_adjacency", SYM + ", d AS (SELECT src AS id, sum(w) AS g FROM sym WHERE w <> 0 GROUP BY src) SELECT src, dst, round(w / sqrt(i.g * j.g), 6) AS w FROM sym JOIN d i ON i.id = src JOIN d j ON j.id = dst WHERE w <> 0")
def _(spark, d):
    return af.normalised(af.symmetrise(weighted_edges(spark, d))).withColumn("w", f6(F.col("w")))


@query("affinity_summary", WEIGHTED + " SELECT count(*) AS n, round(min(w), 6) AS low, round(max(w), 6) AS high, round(avg(w), 6) AS mean FROM edges")
def _(spark, d):
    return weighted_edges(spark, d).agg(F.count("*").alias("n"), f6(F.min("w")).alias("low"), f6(F.max("w")).alias("high"), f6(F.avg("w")).alias("mean"))


@query("cluster_means", PRIM + " SELECT label, i - 1 AS pos, round(avg(e[14 + i]), 6) AS mean, round(stddev_pop(e[14 + i]), 6) AS std, count(*) AS n FROM prim, (SELECT unnest(range(1, 19))::INT AS i) GROUP BY label, i")
def _(spark, d):
    m = cl.cluster_means(primitives(spark, d), "label", "traj")
    return m.select("label", "pos", f6(F.col("mean")).alias("mean"), f6(F.col("std")).alias("std"), "n")


@query("rms_displacement", PRIM + " SELECT label, round(sqrt(avg((pow(e[14 + 3*t + 1] - e[15], 2) + pow(e[14 + 3*t + 2] - e[16], 2) + pow(e[14 + 3*t + 3] - e[17], 2)))), 6) AS rms FROM prim, (SELECT unnest(range(0, 6))::INT AS t) GROUP BY label")
def _(spark, d):
    steps = primitives(spark, d).select("label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda t: F.slice("traj", t * 3 + 1, 3))).alias("p"), F.slice("traj", 1, 3).alias("p0"))
    return steps.groupBy("label").agg(f6(F.sqrt(F.avg(af.square_distance(F.col("p"), F.col("p0"))))).alias("rms"))


MEANS = PRIM + ", m AS (SELECT label, i, avg(e[14 + i]) AS v FROM prim, (SELECT unnest(range(1, 19)) AS i) GROUP BY label, i)"
COS = MEANS + ", z AS (SELECT label, i, v - avg(v) OVER (PARTITION BY label) AS v FROM m), cs AS (SELECT a.label AS a, b.label AS b, sum(a.v*b.v) / greatest(sqrt(sum(a.v*a.v)) * sqrt(sum(b.v*b.v)), 1e-12) AS cosine FROM z a JOIN z b ON a.i = b.i AND a.label < b.label GROUP BY ALL)"


@query("cluster_cosine", COS + " SELECT a, b, round(cosine, 6) AS cosine FROM cs")
def _(spark, d):
    v = cl.cluster_vectors(primitives(spark, d), "label", "traj")
    return cl.pairwise_cosine(v, "label", "mean", scalar_centred=True).withColumn("cosine", f6(F.col("cosine")))


CC = ", both_ AS (SELECT a, b FROM cs WHERE cosine > 0.1 UNION ALL SELECT b, a FROM cs WHERE cosine > 0.1), reach(a, b, hop) AS (SELECT label, label, 0 FROM (SELECT DISTINCT label FROM prim) UNION SELECT r.a, e.b, r.hop + 1 FROM reach r JOIN both_ e ON e.a = r.b WHERE r.hop < 10), root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a), sz AS (SELECT root, count(*) AS n FROM root GROUP BY root), o AS (SELECT root, row_number() OVER (ORDER BY n DESC, root) AS merged FROM sz)"
MERGED = COS.replace("WITH", "WITH RECURSIVE", 1) + CC


def merged(spark, d):
    p = primitives(spark, d)
    pairs = cl.pairwise_cosine(cl.cluster_vectors(p, "label", "traj"), "label", "mean", scalar_centred=True)
    return cl.merge_groups(pairs, p.select(F.col("label").alias("id")).distinct(), F.col("cosine") > 0.1)


@query("component_merge", MERGED + " SELECT id, merged FROM root JOIN o USING (root)")
def _(spark, d):
    return merged(spark, d)


@query("label_remap", MERGED + " SELECT p.id, merged AS label FROM prim p JOIN root r ON r.id = p.label JOIN o USING (root)")
def _(spark, d):
    m = merged(spark, d).select(F.col("id").alias("old"), "merged")
    return primitives(spark, d).join(m, F.col("label") == F.col("old")).select("id", F.col("merged").alias("label"))


@query("connected_components", KNN.replace("WITH", "WITH RECURSIVE", 1) + ", near AS (SELECT src AS a, dst AS b FROM knn WHERE d2 < 0.004 UNION SELECT dst, src FROM knn WHERE d2 < 0.004), reach(a, b) AS (SELECT a, a FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b) SELECT a AS node, min(b) AS component FROM reach GROUP BY a")
def _(spark, d):
    return connected_components(knn_edges(spark, d).where("d2 < 0.004"))


@query("top_by_opacity", PRIM + " SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY e[14] DESC, id) AS rank FROM prim QUALIFY rank <= 5")
def _(spark, d):
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.col("opacity").desc(), "id"))
    return primitives(spark, d).withColumn("rank", rank).where("rank <= 5").select("label", "id", F.col("rank").cast("long").alias("rank"))


@query("prune_mask", PRIM + " SELECT id FROM prim WHERE NOT (1 / (1 + exp(-e[14])) < 0.48 OR greatest(exp(e[7]), exp(e[8]), exp(e[9])) > 1.2)")
def _(spark, d):
    big = F.array_max(F.transform("scale", lambda s: F.exp(s))) > 1.2
    return primitives(spark, d).where(~((sigmoid(F.col("opacity")) < 0.48) | big)).select("id")


@query("palette_colors", PRIM + " SELECT id, label % 17 AS by_17, (label - 1) % 16 AS by_16, ((label * 2654435761) & 255) AS hashed, round((0.5 + 0.28209479177387814 * e[4]), 6) AS red, round((e[4] - 0.5) / 0.28209479177387814, 6) AS sh FROM prim")
def _(spark, d):
    l, c0 = F.col("label").cast("long"), 0.28209479177387814
    r = F.get("f_dc", 0)
    return primitives(spark, d).select("id", (F.col("label") % 17).alias("by_17"), ((F.col("label") - 1) % 16).alias("by_16"), (l * 2654435761).bitwiseAND(255).alias("hashed"), f6(0.5 + c0 * r).alias("red"), f6((r - 0.5) / c0).alias("sh"))


@query("positional_embedding", PRIM + " SELECT id, k, round(sin(pow(2, k) * e[1]), 6) AS s, round(cos(pow(2, k) * e[1]), 6) AS c FROM prim, (SELECT unnest(range(0, 6))::INT AS k)")
def _(spark, d):
    wave = F.pow(F.lit(2.0), F.col("k")) * F.col("x")
    return primitives(spark, d).select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select("id", "k", f6(F.sin(wave)).alias("s"), f6(F.cos(wave)).alias("c"))


@query("unit_features", PRIM + ", n AS (SELECT *, greatest(sqrt(" + _sum("e[{i}]*e[{i}]", 57, 8) + "), 1e-12) AS n FROM prim) SELECT id, round(e[57] / n, 6) AS f0, round(e[64] / n, 6) AS f7, round(ln(0.9 / 0.1) + e[14], 6) AS logit FROM n")
def _(spark, d):
    n = F.greatest(norm(F.col("feats")), F.lit(1e-12))
    return primitives(spark, d).select("id", f6(F.get("feats", 0) / n).alias("f0"), f6(F.get("feats", 7) / n).alias("f7"), f6(F.log(F.lit(0.9 / 0.1)) + F.col("opacity")).alias("logit"))


@query("projected_pixels", PRIM + ", v AS (SELECT unnest(range(0, 4))::INT AS view), c AS (SELECT id, view, e[1] * cos(view) + e[3] * sin(view) AS px, e[2] AS py, 1 - e[1] * sin(view) + e[3] * cos(view) AS pz FROM prim, v) SELECT id, view, floor(64 + 100 * px / pz)::BIGINT AS u, floor(64 + 100 * py / pz)::BIGINT AS w FROM c WHERE pz > 1e-6 AND 64 + 100 * px / pz >= 0 AND 64 + 100 * px / pz < 128 AND 64 + 100 * py / pz >= 0 AND 64 + 100 * py / pz < 128")
def _(spark, d):
    views = spark.range(0, 4).select(F.col("id").cast("int").alias("view"))  # cameras: a fixed small table
    v = F.col("view")
    c = primitives(spark, d).crossJoin(F.broadcast(views)).select("id", "view", (F.col("x") * F.cos(v) + F.col("z") * F.sin(v)).alias("px"), F.col("y").alias("py"), (1 - F.col("x") * F.sin(v) + F.col("z") * F.cos(v)).alias("pz"))
    c = c.where("pz > 1e-6").select("id", "view", (64 + 100 * F.col("px") / F.col("pz")).alias("u"), (64 + 100 * F.col("py") / F.col("pz")).alias("w"))
    return c.where("u >= 0 AND u < 128 AND w >= 0 AND w < 128").select("id", "view", F.floor("u").alias("u"), F.floor("w").alias("w"))


@query("cloud_extent", PRIM + ", m AS (SELECT avg(e[1]) AS x, avg(e[2]) AS y, avg(e[3]) AS z FROM prim) SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(1.1 * max(sqrt(pow(e[1] - x, 2) + pow(e[2] - y, 2) + pow(e[3] - z, 2))), 6) AS radius FROM prim, m GROUP BY ALL")
def _(spark, d):
    p = primitives(spark, d)
    centre = p.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    far = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "yz"), (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))))
    one = p.crossJoin(F.broadcast(centre)).agg(*(f6(F.first(f"m{c}")).alias(c) for c in "xyz"), f6(1.1 * F.max(far)).alias("radius"))
    return one
