"""Queries of rigid motions, cameras, harmonics, schedules and structural likeness."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gneiss.functions import geometry as geo
from gneiss.functions import rigid as rg
from gneiss.functions.safe import f6
from gneiss.operators import affinity as af
from gneiss.operators import framing
from gneiss.operators import raster as rs
from gneiss.plans.carriers import SQL, pixels, primitives
from gneiss.plans.graph import ROTATED
from gneiss.session import table

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


def _rounded(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


def _named(vector, prefix: str) -> list:
    return [f6(c).alias(f"{prefix}{i}") for i, c in enumerate(vector)]


@query("rotation_quaternions", PRIM + ", n AS (SELECT *, sqrt(e[10]*e[10] + e[11]*e[11] + e[12]*e[12] + e[13]*e[13]) * CASE WHEN e[10] < 0 THEN -1 ELSE 1 END AS n FROM prim) SELECT id, " + _rounded(**{f"q{i}": f"e[{10 + i}] / n" for i in range(4)}) + " FROM n")
def _(spark, d):
    p = primitives(spark, d).select("id", F.array(*(F.array(*row) for row in af.rotation_rows(F.col("rot")))).alias("r"))
    r = [rg.vector(F.get("r", i)) for i in range(3)]
    return p.select("id", *_named(rg.quaternion_of(r), "q"))


ANGLES, MOVE, SCALE = (0.3, 0.5, -0.2), (0.1, -0.2, 0.3), 2.0
_R = lambda a, s: [f"cos({a})", f"{s}sin({a})"]
EULER = (
    PRIM + f", z AS (SELECT id, e, {SCALE}*(cos({ANGLES[2]})*e[1] - sin({ANGLES[2]})*e[2]) AS x1, {SCALE}*(sin({ANGLES[2]})*e[1] + cos({ANGLES[2]})*e[2]) AS y1, {SCALE}*e[3] AS z1 FROM prim), "
    f"y AS (SELECT *, cos({ANGLES[1]})*x1 + sin({ANGLES[1]})*z1 AS x2, y1 AS y2, cos({ANGLES[1]})*z1 - sin({ANGLES[1]})*x1 AS z2 FROM z), "
    f"x AS (SELECT *, x2 AS x3, cos({ANGLES[0]})*y2 - sin({ANGLES[0]})*z2 AS y3, sin({ANGLES[0]})*y2 + cos({ANGLES[0]})*z2 AS z3 FROM y)"
)


@query("euler_transform", EULER + " SELECT id, " + _rounded(**{f"p{i}": f"{c}3 + {MOVE[i]}" for i, c in enumerate("xyz")}, s0=f"{SCALE} * e[7]", turned=f"abs(({' + '.join(f'e[{10 + i}]*{q!r}' for i, q in enumerate(rg.euler_quaternion(*ANGLES)))}) / sqrt(e[10]*e[10] + e[11]*e[11] + e[12]*e[12] + e[13]*e[13]))") + " FROM x")
def _(spark, d):
    """Points scaled, turned about x after y after z, and moved; ``turned`` is the cosine between old rotation and the turn."""
    turn = rg.euler_quaternion(*ANGLES)
    q = F.array(*map(F.lit, turn))
    p = primitives(spark, d).select("id", "scale", F.array(*(F.col(c) * SCALE for c in "xyz")).alias("p"), "rot", geo.quaternion_product(q, F.col("rot")).alias("turned"))
    at = rg.plus(rg.times(af.rotation_rows(q), rg.vector(F.col("p"))), [F.lit(m) for m in MOVE])
    n = F.sqrt(sum((F.get("turned", i) * F.get("turned", i) for i in range(1, 4)), F.get("turned", 0) * F.get("turned", 0)))
    # The turned rotation times the inverse of the turn's square gives the cosine with the turn itself.
    back = geo.quaternion_product(F.array(F.lit(turn[0]), *(F.lit(-v) for v in turn[1:])), F.transform("turned", lambda v: v / n))
    cosine = sum((F.get(back, i) * turn[i] for i in range(1, 4)), F.get(back, 0) * turn[0])
    return p.select("id", *_named(at, "p"), f6(F.get("scale", 0) * SCALE).alias("s0"), f6(F.abs(cosine)).alias("turned"))


def _angular(degree: int) -> str:
    """The same sum over polar angles."""
    terms = []
    for i, (m, factor, polynomial) in enumerate(rg.harmonic_terms(degree)):
        height = " + ".join(f"({c!r}) * pow(cos(polar), {k})" for k, c in enumerate(polynomial))
        wave = f"cos({m} * around)" if m >= 0 else f"sin({-m} * around)"
        terms.append(f"e[{i + 1}] * ({factor!r}) * ({height}) * pow(sin(polar), {abs(m)}) * {wave}")
    return " + ".join(terms)


DIRECTION = PRIM + ", v AS (SELECT id, e, acos(e[35] / sqrt(e[33]*e[33] + e[34]*e[34] + e[35]*e[35])) AS polar, atan2(e[34], e[33]) AS around FROM prim)"


@query("harmonic_colours", DIRECTION + " SELECT id, " + _rounded(**{f"degree_{n}": _angular(n) for n in range(5)}, rgb=f"0.5 + e[1] * {math.sqrt(1 / (4 * math.pi))!r}", back=f"(e[1] - 0.5) / {math.sqrt(1 / (4 * math.pi))!r}") + " FROM v")
def _(spark, d):
    """Spherical harmonics of degrees 0 to 4 at each point's direction; colour of the constant term and back."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda q: q.cast("double")).alias("e"))
    v = rg.vector(F.col("e"), 32)
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    e = e.withColumn("v", F.array(*(c / n for c in v)))
    c0 = rg.harmonic_terms(0)[0][1]
    values = [f6(rg.harmonic_value(F.col("e"), rg.vector(F.col("v")), n)).alias(f"degree_{n}") for n in range(5)]
    return e.select("id", *values, f6(0.5 + F.get("e", 0) * c0).alias("rgb"), f6((F.get("e", 0) - 0.5) / c0).alias("back"))


_T = ["e[4]", "e[5]", "e[6]"]
_CENTRE = [f"(-(r{i}0*{_T[0]} + r{i}1*{_T[1]} + r{i}2*{_T[2]}) + {MOVE[i]})" for i in range(3)]
NEAR, FAR = 0.01, 100.0
VIEW = ROTATED + ", c AS (SELECT *, " + ", ".join(f"{c} AS c{i}" for i, c in enumerate(_CENTRE)) + " FROM r), t AS (SELECT *, " + ", ".join(f"-{SCALE}*(r0{i}*c0 + r1{i}*c1 + r2{i}*c2) AS t{i}, -(r0{i}*c0 + r1{i}*c1 + r2{i}*c2) AS m{i}" for i in range(3)) + " FROM c), w AS (SELECT *, " + ", ".join(f"r0{i}*e[57] + r1{i}*e[58] + r2{i}*e[59] + t{i} AS v{i}" for i in range(3)) + " FROM t)"


@query("camera_views", VIEW + f" SELECT id, " + _rounded(**{f"t{i}": f"t{i}" for i in range(3)}, **{f"v{i}": f"v{i}" for i in range(3)}, n0="v0 / tan((0.6 + abs(e[1])) / 2) / (v2 + 1e-7)", n1="v1 / tan((0.8 + abs(e[2])) / 2) / (v2 + 1e-7)") + f", round(({FAR} / ({FAR} - {NEAR}) * v2 - {FAR} * {NEAR} / ({FAR} - {NEAR})) / (v2 + 1e-7), 4) AS n2 FROM w WHERE abs(v2) > 0.001")
def _(spark, d):
    """A point seen by each camera: view translation, view coordinates, and coordinates after the perspective divide."""
    p = primitives(spark, d).select("id", "x", "y", "f_dc", "feats", F.array(*(F.array(*row) for row in af.rotation_rows(F.col("rot")))).alias("r"))
    r = [rg.vector(F.get("r", i)) for i in range(3)]
    p = p.withColumn("t", F.array(*rg.moved_view(r, rg.vector(F.col("f_dc")), MOVE, SCALE)))
    p = p.withColumn("v", F.array(*rg.plus(rg.times(rg.transposed(r), rg.vector(F.col("feats"))), rg.vector(F.col("t")))))
    lens, v = rg.projection(NEAR, FAR, 0.6 + F.abs("x"), 0.8 + F.abs("y")), rg.vector(F.col("v"))
    w = lens[3, 2] * v[2] + 1e-7
    seen = p.where(F.abs(v[2]) > 0.001)
    n2 = F.round((lens[2, 2] * v[2] + lens[2, 3]) / w, 4)
    return seen.select("id", *_named(rg.vector(F.col("t")), "t"), *_named(v, "v"), f6(lens[0, 0] * v[0] / w).alias("n0"), f6(lens[1, 1] * v[1] / w).alias("n1"), n2.alias("n2"))


@query("moved_cameras", VIEW + " SELECT id, " + _rounded(**{f"t{i}": f"m{i}" for i in range(3)}) + " FROM t")
def _(spark, d):
    """The translation of each camera once its centre is moved."""
    p = primitives(spark, d)
    return p.select("id", *_named(rg.moved_view(af.rotation_rows(F.col("rot")), rg.vector(F.col("f_dc")), MOVE), "t"))


# Screw motions: axis from f_dc, moment from scale, magnitude from x; the logarithm is taken of the motion again.
_W, _V = ["w0", "w1", "w2"], ["e[7]", "e[8]", "e[9]"]
_cross = lambda a, b: [f"({a[1]}*{b[2]} - {a[2]}*{b[1]})", f"({a[2]}*{b[0]} - {a[0]}*{b[2]})", f"({a[0]}*{b[1]} - {a[1]}*{b[0]})"]
_WV = _cross(_W, _V)
_WWV = _cross(_W, ["x0", "x1", "x2"])
SCREW = (
    PRIM + ", a AS (SELECT id, e, 0.5 + abs(e[1]) AS t, sqrt(e[4]*e[4] + e[5]*e[5] + e[6]*e[6]) AS n FROM prim), w AS (SELECT *, e[4]/n AS w0, e[5]/n AS w1, e[6]/n AS w2 FROM a), "
    f"x AS (SELECT *, {', '.join(f'{c} AS x{i}' for i, c in enumerate(_WV))} FROM w), y AS (SELECT *, {', '.join(f'{c} AS y{i}' for i, c in enumerate(_WWV))} FROM x)"
)

_P = ["p0", "p1", "p2"]
_UP = _cross(_W, _P)
#: The motion's system is a scaling along the axis, and a scaling with a quarter turn across it.
SCREW += (
    ", p AS (SELECT *, " + ", ".join(f"t*{_V[i]} + (1 - cos(t))*x{i} + (t - sin(t))*y{i} AS p{i}" for i in range(3)) + ", t + 1e-5 AS a, sin(t) / sin(t + 1e-5) AS f FROM y), "
    "q AS (SELECT *, w0*p0 + w1*p1 + w2*p2 AS along, a - (a - sin(a))*f*f AS s, (1 - cos(a))*f AS c FROM p)"
)


@query("screw_motions", SCREW + " SELECT id, " + _rounded(**{f"p{i}": f"p{i}" for i in range(3)}, **{f"w{i}": f"w{i} * f" for i in range(3)}, **{f"v{i}": f"along*w{i}/a + (s*(p{i} - along*w{i}) - c*{_UP[i]}) / (s*s + c*c)" for i in range(3)}, angle="a") + " FROM q")
def _(spark, d):
    """Exponentials of screw motions, and the screw that their logarithm gives back."""
    n = F.sqrt(sum((F.get("f_dc", i) * F.get("f_dc", i) for i in range(1, 3)), F.get("f_dc", 0) * F.get("f_dc", 0)))
    p = primitives(spark, d).select("id", F.transform("f_dc", lambda v: v / n).alias("w"), F.col("scale").alias("v"), (0.5 + F.abs("x")).alias("angle"))
    w, v = rg.vector(F.col("w")), rg.vector(F.col("v"))
    p = p.select("id", F.array(*(F.array(*row) for row in geo.rotation_of(F.col("w"), F.col("angle")))).alias("r"), F.array(*rg.screw_translation(w, v, F.col("angle"))).alias("p"))
    lw, lv, angle = rg.screw_log([rg.vector(F.get("r", i)) for i in range(3)], rg.vector(F.col("p")))
    return p.select("id", *_named(rg.vector(F.col("p")), "p"), *_named(lw, "w"), *_named(lv, "v"), f6(angle).alias("angle"))


@query("step_schedules", "SELECT p_partkey, round((0.01 * (1 - least(1, p_partkey / 1500)) + 0.0001 * least(1, p_partkey / 1500)) * (0.1 + 0.9 * sin(0.5 * pi() * least(1, p_partkey / 100))), 8) AS rate, CASE WHEN p_partkey <= 50 THEN 1.0 WHEN p_partkey <= 120 THEN 0.5 ELSE 0.25 END::DOUBLE AS weight FROM part")
def _(spark, d):
    step = F.col("p_partkey")
    rate = geo.linear_rate(step, 1500, 0.01, 0.0001, 100, 0.1)
    return table(spark, d, "part").select("p_partkey", F.round(rate, 8).alias("rate"), geo.landmark_value(step, [10, 50, 120], [1.0, 0.5, 0.25]).alias("weight"))


# Structural likeness of an image of sums and one of counts, on a 50 x 50 grid, in a Gaussian window of 11 x 11.
_G = [math.exp(-((i - 5) ** 2) / 4.5) for i in range(11)]
_WEIGHTS = ", ".join(f"({i - 5}, {w / sum(_G)!r}::DOUBLE)" for i, w in enumerate(_G))
SSIM = (
    f"WITH {SQL['pixels']}, img AS (SELECT user_id % 3 AS plane, y, x, sum(value) / 100 AS a, count(*) / 10 AS b FROM pixels GROUP BY ALL), g(o, w) AS (VALUES {_WEIGHTS}), "
    "c AS (SELECT plane, y + p.o AS y, x + q.o AS x, sum(p.w * q.w * a) AS ma, sum(p.w * q.w * b) AS mb, sum(p.w * q.w * a * a) AS aa, sum(p.w * q.w * b * b) AS bb, sum(p.w * q.w * a * b) AS ab "
    "FROM img, g p, g q WHERE y + p.o BETWEEN 0 AND 49 AND x + q.o BETWEEN 0 AND 49 GROUP BY ALL), "
    "s AS (SELECT plane, ((2*ma*mb + 0.0001) * (2*(ab - ma*mb) + 0.0009)) / ((ma*ma + mb*mb + 0.0001) * (aa - ma*ma + bb - mb*mb + 0.0009)) AS s FROM c) "
    "SELECT plane, round((sum(s) + 2500 - count(*)) / 2500, 6) AS ssim FROM s GROUP BY plane"
)


@query("structural_likeness", SSIM)
def _(spark, d):
    images = pixels(spark, d).groupBy((F.col("user_id") % 3).alias("plane"), "y", "x").agg((F.sum("value") / 100).alias("a"), (F.count("*") / 10).alias("b"))
    return rs.structural_likeness(images, ["plane"], 50, 50).withColumn("ssim", f6(F.col("ssim")))


VIEWS = (
    ROTATED + ", c AS (SELECT r.*, p.label, " + ", ".join(f"-(r{a}0 * r.e[1] + r{a}1 * r.e[2] + r{a}2 * r.e[3]) AS c{a}" for a in range(3)) + " FROM r JOIN prim p ON p.id = r.id), "
    "m AS (SELECT label, " + ", ".join(f"avg(c{a}) AS m{a}" for a in range(3)) + " FROM c GROUP BY label), "
    "b AS (SELECT label, max(sqrt(" + " + ".join(f"(c{a} - m{a}) * (c{a} - m{a})" for a in range(3)) + ")) AS radius FROM c JOIN m USING (label) GROUP BY label)"
)


def _views(spark, d):
    rotation = F.array(*(F.array(*row) for row in af.rotation_rows(F.col("rot"))))
    return primitives(spark, d).select("id", F.col("label").alias("scene"), rotation.alias("rotation"), F.array("x", "y", "z").alias("translation"))


@query("scene_bounds", VIEWS + " SELECT label AS scene, " + _rounded(m0="m0", m1="m1", m2="m2", radius="radius") + " FROM m JOIN b USING (label)")
def _(spark, d):
    return framing.bounds(_views(spark, d)).select("scene", *_named(rg.vector(F.col("middle")), "m"), f6(F.col("radius")).alias("radius"))


@query("placed_cameras", VIEWS + " SELECT id, " + _rounded(**{f"t{j}": "-(" + " + ".join(f"r{i}{j} * (c{i} - m{i})" for i in range(3)) + ") / nullif(radius, 0)" for j in range(3)}) + " FROM c JOIN m USING (label) JOIN b USING (label)")
def _(spark, d):
    """Cameras seen from the mean of their scene's, the farthest at distance 1."""
    cameras = _views(spark, d)
    frames = framing.bounds(cameras).withColumnRenamed("radius", "divisor")
    return framing.placed_cameras(cameras, frames).select("id", *_named(rg.vector(F.col("translation")), "t"))
