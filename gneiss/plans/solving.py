"""Queries of iterative solvers and raster kernels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gneiss.functions.safe import f6, iou
from gneiss.operators import affinity as af
from gneiss.operators import hierarchy as hi
from gneiss.operators import raster as rs
from gneiss.operators import solvers as sv
from gneiss.plans.carriers import SQL, pixels, primitives
from gneiss.plans.graph import weighted_edges
from gneiss.storage import materialise

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PIX = f"WITH {SQL['pixels']}"
IMG = PIX + ", img AS (SELECT user_id % 3 AS plane, y, x, sum(value) AS v FROM pixels GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def images(spark, d):
    return pixels(spark, d).groupBy((F.col("user_id") % 3).alias("plane"), "y", "x").agg(F.sum("value").alias("v"))


def _shift(kernel: dict) -> str:
    return ", ".join(f"({dy}, {dx}, {w})" for (dy, dx), w in kernel.items())


SOBEL = " ".join(
    f", {n} AS (SELECT p.plane, p.y, p.x, coalesce(sum(q.v * w), 0) AS g FROM img p LEFT JOIN (SELECT i.*, dy, dx, w FROM img i, (VALUES {_shift(k)}) o(dy, dx, w)) q ON q.plane = p.plane AND q.y = p.y + q.dy AND q.x = p.x + q.dx GROUP BY ALL)"
    for n, k in (("gx", rs.SOBEL_X), ("gy", rs.SOBEL_Y))
)


@query("sobel_edges", IMG + SOBEL + " SELECT plane, y, x, round(sqrt(gx.g * gx.g + gy.g * gy.g), 4) AS edge FROM gx JOIN gy USING (plane, y, x)")
def _(spark, d):
    return rs.edge_strength(images(spark, d), ["plane"]).withColumn("edge", F.round("edge", 4))


@query("scaled_values", IMG + ", t AS (SELECT plane, quantile_cont(v, 0.95) AS top FROM img GROUP BY plane) SELECT plane, y, x, round(least(1, greatest(0, v / greatest(top, 1e-8))), 6) AS v FROM img JOIN t USING (plane)")
def _(spark, d):
    return rs.scaled(images(spark, d), ["plane"], "v").select("plane", "y", "x", f6(F.col("v")).alias("v"))


@query(
    "edge_methods",
    IMG + SOBEL + ", t AS (SELECT plane, quantile_cont(v, 0.95) AS top FROM img GROUP BY plane), m AS (SELECT plane, y, x, CASE WHEN least(1, greatest(0, v / greatest(top, 1e-8))) > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS ingested FROM img JOIN t USING (plane) WHERE x % 3 > 0) "
    "SELECT plane, y, x, round(sqrt(gx.g * gx.g + gy.g * gy.g), 4) AS sobel, coalesce(ingested, 0) AS ingested FROM gx JOIN gy USING (plane, y, x) LEFT JOIN m USING (plane, y, x)",
)
def _(spark, d):
    """Edges by both methods; the ingested maps lack a third of the columns."""
    image = images(spark, d)
    maps = rs.scaled(image, ["plane"], "v").where("x % 3 > 0").select("plane", "y", "x", F.col("v").alias("edge"))
    found = rs.edge_maps(image, ["plane"], "ingested", maps=maps, threshold=0.5).withColumnRenamed("edge", "ingested")
    return rs.edge_maps(image, ["plane"]).withColumn("sobel", F.round("edge", 4)).drop("edge").join(found, ["plane", "y", "x"])


_BLUR = [math.exp(-o * o / 2) for o in range(-3, 4)]
BLUR = (
    IMG + f", g(o, w) AS (VALUES {', '.join(f'({i - 3}, {w / sum(_BLUR)!r}::DOUBLE)' for i, w in enumerate(_BLUR))}) "
    "SELECT p.plane, p.y, p.x, round(sum(q.v * a.w * b.w), 6) AS blurred FROM img p JOIN img q ON q.plane = p.plane AND q.y BETWEEN p.y - 3 AND p.y + 3 AND q.x BETWEEN p.x - 3 AND p.x + 3 JOIN g a ON a.o = q.y - p.y JOIN g b ON b.o = q.x - p.x GROUP BY ALL"
)


@query("blurred_images", BLUR)
def _(spark, d):
    return rs.blur(images(spark, d), ["plane"], 1.0).withColumn("blurred", f6(F.col("blurred")))


RAYS = PIX + ", s AS (SELECT frame, y, pixel, k, least(0.9, value / 100) AS a FROM pixels), c AS (SELECT *, a * exp(coalesce(sum(ln(greatest(1 - a, 1e-12))) OVER (PARTITION BY frame, y ORDER BY pixel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS weight FROM s)"


def rays(spark, d):
    s = pixels(spark, d).withColumn("a", F.least(F.lit(0.9), F.col("value") / 100))
    return rs.composited(s, ["frame", "y"], F.col("pixel"), F.col("a"), "pixel")


@query("transmittance", RAYS + " SELECT pixel, round(weight, 6) AS weight FROM c")
def _(spark, d):
    return rays(spark, d).select("pixel", f6(F.col("weight")).alias("weight"))


@query("strongest_cluster", RAYS + ", r AS (SELECT frame, y, k, sum(weight) AS response FROM c GROUP BY ALL) SELECT frame, y, CASE WHEN response > 0.5 THEN k ELSE 0 END AS k, round(response, 6) AS response FROM r QUALIFY row_number() OVER (PARTITION BY frame, y ORDER BY round(response, 12) DESC, k) = 1")
def _(spark, d):
    return rs.strongest_cluster(rays(spark, d), ["frame", "y"]).withColumn("response", f6(F.col("response")))


@query("one_to_one_matches")
def _(spark, d):
    o = pixels(spark, d).groupBy("frame", (F.col("user_id") % 3).alias("object"), "k").agg(F.count_if("gt").alias("inter"), F.count("*").alias("pred"))
    gt = o.groupBy("frame", "object").agg(F.sum("inter").alias("gt"))
    matrix = o.join(gt, ["frame", "object"]).withColumn("iou", iou(F.col("inter"), F.col("pred"), F.col("gt")))
    return sv.match_one_to_one(matrix, "frame").withColumn("iou", f6(F.col("iou")))


@query("communities")
def _(spark, d):
    """Communities, and the modularity of them all."""
    edges = materialise(af.symmetrise(weighted_edges(spark, d)), "symmetric")
    member = sv.communities(edges)
    return member.crossJoin(F.broadcast(sv.modularity(edges, member).select(f6(F.col("q")).alias("q"))))  # one row


@query("spectral_vectors")
def _(spark, d):
    graph = af.normalised(af.symmetrise(weighted_edges(spark, d)))
    vectors, values = sv.top_eigenvectors(graph, 3)
    return vectors.select("id", F.posexplode("vec").alias("at", "v")).withColumn("value", F.get(F.array(*map(F.lit, values)), F.col("at")))


D2 = "(a.e[1]-b.e[1])*(a.e[1]-b.e[1]) + (a.e[2]-b.e[2])*(a.e[2]-b.e[2]) + (a.e[3]-b.e[3])*(a.e[3]-b.e[3])"
DENSITY = (
    f"WITH RECURSIVE {SQL['prim']}, nr AS (SELECT a.id AS id, b.id AS t, {D2} AS d2 FROM prim a, prim b WHERE {D2} <= 0.08::DOUBLE * 0.08::DOUBLE), core AS (SELECT id FROM nr GROUP BY id HAVING count(*) >= 5), "
    "lk AS (SELECT id, t FROM nr WHERE id IN (FROM core) AND t IN (FROM core)), reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, lk.t FROM reach r JOIN lk ON lk.id = r.b), comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a), "
    "rk AS (SELECT c, row_number() OVER (ORDER BY c) AS cluster FROM (SELECT DISTINCT c FROM comp)), br AS (SELECT nr.id, cluster FROM nr JOIN comp ON comp.id = nr.t JOIN rk USING (c) QUALIFY row_number() OVER (PARTITION BY nr.id ORDER BY d2, nr.t) = 1) "
    "SELECT prim.id, coalesce(cluster, 0) AS cluster FROM prim LEFT JOIN br USING (id)"
)
FARTHEST = (
    f"WITH RECURSIVE {SQL['prim']}, f AS (SELECT id, e[57:64] AS v FROM prim), r(step, ch) AS (SELECT 1, [min(id)] FROM f UNION ALL SELECT step + 1, list_append(ch, id) FROM (SELECT r.step, r.ch, p.id, min(list_sum(list_transform(range(1, 9), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))) AS far "
    "FROM r, f p, f c WHERE list_contains(r.ch, c.id) AND r.step < 8 GROUP BY ALL) WHERE far > 0 QUALIFY row_number() OVER (ORDER BY round(far, 12) DESC, id) = 1) SELECT ch[step] AS id, (step - 1)::BIGINT AS rank FROM r"
)


@query("density_clusters", DENSITY)
def _(spark, d):
    return sv.density_clusters(primitives(spark, d), 0.08, 5)


CORES = (
    f"WITH {SQL['prim']}, f AS (SELECT id, e[57:64] AS v FROM prim), r AS (SELECT a.id, sqrt(list_sum(list_transform(range(1, 9), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS gap FROM f a JOIN f b ON a.id <> b.id) "
    "SELECT id, round(gap, 6) AS core FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap) = 5"
)


def features(spark, d):
    return primitives(spark, d).select("id", F.col("feats").alias("vec"))


@query("core_distances", CORES)
def _(spark, d):
    """Distance of each primitive, by its features, to its fifth nearest other one."""
    cores = hi.core_distances(hi._dealt(features(spark, d), 512), 5)
    return cores.select("id", f6(F.col("core")).alias("core"))


@query("density_hierarchy")
def _(spark, d):
    """Clusters of at least 2 % of the primitives; noise goes to the nearest."""
    points = features(spark, d)
    return hi.density_hierarchy(points, max(2, round(points.count() * 0.02)), 5)


@query("farthest_points", FARTHEST)
def _(spark, d):
    chosen = sv.farthest_points(primitives(spark, d), "feats", 8)
    return primitives(spark, d).where(F.col("id").isin(chosen)).select("id", (F.array_position(F.array(*map(F.lit, chosen)), F.col("id")) - 1).alias("rank"))


@query("spectral_embedding")
def _(spark, d):
    """Unit rows of the eigenvectors before the largest gap of the eigenvalues."""
    graph = af.normalised(af.symmetrise(weighted_edges(spark, d)))
    rows, k, ratio_ = sv.spectral_embedding(graph, 6, tolerance=1e-4)
    return rows.select("id", F.size("vec").alias("k"), F.lit(k).alias("wanted"), F.lit(ratio_).alias("ratio"))


# Centres are drawn by races and moved until none changes, as in the operator.
_GAP = "list_sum(list_transform(range(1, 9), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
_RACE = "-ln((('0x' || substr(md5('0:' || ({step}) || ':' || id), 1, 13))::BIGINT + 0.5) / 4503599627370496)"
_NEAREST = f"list_transform(l.cs, lambda c: round({_GAP.format(a='f.v', b='c')}, 12))"
KMEANS = (
    f"WITH RECURSIVE {SQL['prim']}, f AS (SELECT id, e[57:64] AS v FROM prim), s(step, ch) AS (SELECT 1, [arg_min(id, {_RACE.format(step=1)})] FROM f UNION ALL SELECT step + 1, list_append(ch, id) FROM (SELECT s.step, s.ch, p.id, min(round({_GAP.format(a='p.v', b='c.v')}, 12)) AS far "
    f"FROM s, f p, f c WHERE list_contains(s.ch, c.id) AND s.step < 8 GROUP BY ALL) WHERE far > 0 QUALIFY row_number() OVER (ORDER BY {_RACE.format(step='step + 1')} / far, id) = 1), "
    "drawn AS (SELECT unnest(ch) AS id, generate_subscripts(ch, 1) AS j FROM (SELECT ch FROM s ORDER BY step DESC LIMIT 1)), "
    f"l(step, cs) AS (SELECT 0, list(v ORDER BY j) FROM drawn JOIN f USING (id) UNION ALL SELECT step, cs FROM (SELECT step + 1 AS step, cs AS old, list_transform(range(1, len(cs) + 1), lambda j: coalesce(list_filter(list(m), lambda x: x.j = j)[1].v, cs[j])) AS cs "
    f"FROM (SELECT step, cs, {{'j': j, 'v': [{', '.join(f'round(avg(v[{i}]), 9)' for i in range(1, 9))}]}} AS m FROM (SELECT l.step, l.cs, f.v, list_position({_NEAREST}, list_min({_NEAREST})) AS j FROM l, f) GROUP BY step, cs, j) GROUP BY step, cs) WHERE cs <> old AND step <= 300) "
    f"SELECT id, (list_position({_NEAREST}, list_min({_NEAREST})) - 1)::BIGINT AS cluster FROM (SELECT cs FROM l ORDER BY step DESC LIMIT 1) l, f"
)


@query("feature_kmeans", KMEANS)
def _(spark, d):
    return sv.clusterer("kmeans")(primitives(spark, d), "feats", 8)
