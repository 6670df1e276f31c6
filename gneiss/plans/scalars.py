"""Queries of scalar geometry, schedules and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import geometry as geo
from gneiss.functions.safe import f6
from gneiss.plans.carriers import SQL, primitives
from gneiss.session import table
from gneiss.sources.reports import upsert

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


A, B = [f"e[{i}]" for i in range(10, 14)], [f"e[{i}]" for i in range(33, 37)]
PRODUCT = [
    "{a[0]}*{b[0]} - {a[1]}*{b[1]} - {a[2]}*{b[2]} - {a[3]}*{b[3]}", "{a[0]}*{b[1]} + {a[1]}*{b[0]} + {a[2]}*{b[3]} - {a[3]}*{b[2]}",
    "{a[0]}*{b[2]} - {a[1]}*{b[3]} + {a[2]}*{b[0]} + {a[3]}*{b[1]}", "{a[0]}*{b[3]} + {a[1]}*{b[2]} - {a[2]}*{b[1]} + {a[3]}*{b[0]}",
]


@query("quaternion_product", PRIM + " SELECT id, " + ", ".join(f"round({p.format(a=A, b=B)}, 6) AS q{i}" for i, p in enumerate(PRODUCT)) + " FROM prim")
def _(spark, d):
    q = primitives(spark, d).select("id", geo.quaternion_product(F.col("rot"), F.slice("dquat", 1, 4)).alias("q"))
    return q.select("id", *(f6(F.get("q", i)).alias(f"q{i}") for i in range(4)))


@query("axis_rotation", PRIM + ", a AS (SELECT id, e[1] AS t, e[4]/n AS x, e[5]/n AS y, e[6]/n AS z FROM (SELECT *, sqrt(e[4]*e[4] + e[5]*e[5] + e[6]*e[6]) AS n FROM prim)) SELECT id, round(cos(t) + x*x*(1 - cos(t)), 6) AS r00, round(x*y*(1 - cos(t)) - z*sin(t), 6) AS r01, round(z*x*(1 - cos(t)) - y*sin(t), 6) AS r20 FROM a")
def _(spark, d):
    n = F.sqrt(sum((F.get("f_dc", i) * F.get("f_dc", i) for i in range(1, 3)), F.get("f_dc", 0) * F.get("f_dc", 0)))
    r = geo.rotation_of(F.transform("f_dc", lambda v: v / n), F.col("x"))
    return primitives(spark, d).select("id", f6(r[0][0]).alias("r00"), f6(r[0][1]).alias("r01"), f6(r[2][0]).alias("r20"))


@query("focal_lengths", "SELECT p_partkey, round(2 * atan(p_size::DOUBLE / (2 * p_retailprice)), 9) AS fov, round(p_size / (2 * tan((0.2 + p_size::DOUBLE / 100) / 2)), 6) AS focal FROM part")
def _(spark, d):
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(geo.field_of_view(F.col("p_retailprice"), size), 9).alias("fov"), f6(geo.focal_length(0.2 + size / 100, size)).alias("focal"))


@query("rate_schedule", "SELECT p_partkey, round(exp(ln(0.01) * (1 - least(1, p_partkey / 1500)) + ln(0.0001) * least(1, p_partkey / 1500)) * (0.1 + 0.9 * sin(0.5 * pi() * least(1, p_partkey / 100))), 8) AS rate FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(geo.geometric_rate(F.col("p_partkey"), 1500, 0.01, 0.0001, 100, 0.1), 8).alias("rate"))


@query("colour_mixes", PRIM + " SELECT id, round(0.2126*e[4] + 0.7152*e[5] + 0.0722*e[6], 6) AS luminance, round(e[4]*0.25 + 1*(1 - 0.25), 6) AS blended, round(ln(least(1/(1+exp(-e[14])), 0.01) / (1 - least(1/(1+exp(-e[14])), 0.01))), 6) AS reset FROM prim")
def _(spark, d):
    r, g, b = (F.get("f_dc", i) for i in range(3))
    return primitives(spark, d).select("id", f6(geo.luminance(r, g, b)).alias("luminance"), f6(geo.over_background(r, F.lit(0.25), 1.0)).alias("blended"), f6(geo.reset_opacity(F.col("opacity"))).alias("reset"))


@query("timings_upsert", "WITH o AS (SELECT event_type AS step, round(min(value), 6) AS s FROM events GROUP BY ALL), f AS (SELECT event_type AS step, round(max(value), 6) AS s FROM events WHERE event_type > 'm' GROUP BY ALL) SELECT * FROM o WHERE step NOT IN (SELECT step FROM f) UNION ALL SELECT * FROM f")
def _(spark, d):
    e = table(spark, d, "events")
    old = e.groupBy(F.col("event_type").alias("step")).agg(f6(F.min("value")).alias("s"))
    fresh = e.where("event_type > 'm'").groupBy(F.col("event_type").alias("step")).agg(f6(F.max("value")).alias("s"))
    return upsert(old, fresh, ["step"])
