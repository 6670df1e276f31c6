"""Queries of selections, samples, losses, running statistics and metadata defaults."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gneiss.functions.safe import f6
from gneiss.operators import evaluation as ev
from gneiss.operators import selection as sl
from gneiss.operators.ordering import positions, uniform
from gneiss.plans.carriers import SQL, pixels, primitives
from gneiss.plans.evaluation import UNIFORM
from gneiss.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PRIM, PIX = f"WITH {SQL['prim']}", f"WITH {SQL['pixels']}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _u(*keys: str) -> str:
    return UNIFORM.format(key=" || '|' || ".join(f"({k})::VARCHAR" for k in keys))


@query("shape_matches", "WITH a AS (SELECT p_partkey AS id, p_size % 4 AS h, p_partkey % 5 AS w FROM part), b AS (SELECT p_partkey AS id, p_partkey % 5 AS h, p_size % 3 AS w FROM part) SELECT id, CASE WHEN a.h = b.h AND a.w = b.w THEN 'direct' WHEN a.h = b.w AND a.w = b.h THEN 'transposed' END AS match, a.h = b.h AND a.w = b.w AS strict FROM a JOIN b USING (id)")
def _(spark, d):
    part = table(spark, d, "part")
    a = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("h"), (F.col("p_partkey") % 5).alias("w"))
    b = part.select(F.col("p_partkey").alias("of"), (F.col("p_partkey") % 5).alias("bh"), (F.col("p_size") % 3).alias("bw"))
    h, w, bh, bw = (F.col(c) for c in ("h", "w", "bh", "bw"))
    return a.join(b, F.col("id") == F.col("of")).select("id", sl.shape_match(h, w, bh, bw).alias("match"), sl.shape_match(h, w, bh, bw, transpose=False).isNotNull().alias("strict"))


@query("sampled_pixels", PIX + f", n AS (SELECT count(*) AS n FROM pixels) SELECT pixel FROM pixels, n WHERE {_u('pixel')} < 500.0 / n AND k > 0")
def _(spark, d):
    p = pixels(spark, d).where("k > 0")
    n = pixels(spark, d).agg(F.count("*").alias("n"))
    return sl.bernoulli(p.crossJoin(F.broadcast(n)), 500.0 / F.col("n"), F.col("pixel")).select("pixel")


@query("subsample", f"SELECT o_orderkey FROM orders ORDER BY {_u('o_orderkey')}, o_orderkey LIMIT 200")
def _(spark, d):
    return sl.subsample(table(spark, d, "orders").select("o_orderkey"), 200, F.col("o_orderkey"))


@query("shuffled", f"SELECT c_custkey, row_number() OVER (ORDER BY {_u('c_custkey')}, c_custkey) - 1 AS at FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", uniform(F.col("c_custkey")).alias("u"))
    return positions(c, ["u", "c_custkey"]).select("c_custkey", F.col("at").cast("long").alias("at"))


BIG = "greatest(exp(e[7]), exp(e[8]), exp(e[9])) > 0.01 * 110"
_DRAW = " + ".join(f"exp(e[{7 + i}]) * sqrt(-2 * ln(1 - {_u('id', str(i), '0')})) * cos(2 * pi() * {_u('id', str(i), '1')})" for i in range(3))


@query("growth_masks", PRIM + f" SELECT id, CASE WHEN abs(e[15]) >= 0.1 AND NOT ({BIG}) THEN 'clone' WHEN abs(e[15]) >= 0.1 AND {BIG} THEN 'split' END AS kind, round(e[1] + e[2] + e[3] + CASE WHEN abs(e[15]) >= 0.1 AND {BIG} THEN {_DRAW} ELSE 0 END, 6) AS place FROM prim")
def _(spark, d):
    """Which primitives are cloned or split, and the sum of the coordinates of what comes of them."""
    scale = F.transform("scale", lambda s: F.exp(s))
    p = primitives(spark, d).withColumn("kind", sl.growth_masks(F.abs(F.get("traj", 0)), scale, 0.1, 0.01, 110.0))
    moved = [F.coalesce(F.when(F.col("kind") == "split", o), F.lit(0.0)) for o in sl.split_offsets(scale, F.col("id"))]
    return p.select("id", "kind", f6(F.col("x") + F.col("y") + F.col("z") + (moved[0] + moved[1] + moved[2])).alias("place"))


@query("dataset_paths", "SELECT page_id, list_contains(string_split(url, '/'), 'a') AS has, len(string_split(url, '/')) AS parts, coalesce(CASE WHEN page_id % 3 = 0 THEN url END, 'default') AS folder FROM pages")
def _(spark, d):
    parts = F.split("url", "/")
    chosen = F.coalesce(F.when(F.col("page_id") % 3 == 0, F.col("url")), F.lit("default"))
    return table(spark, d, "pages").select("page_id", F.array_contains(parts, "a").alias("has"), F.size(parts).cast("long").alias("parts"), chosen.alias("folder"))


@query("object_names", "WITH s AS (SELECT n_regionkey AS scene, count(*) > 5 AS nested FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY ALL UNION ALL SELECT 99, false) SELECT scene, coalesce(n_name, 'foreground') AS object FROM s LEFT JOIN nation ON nested AND n_regionkey = scene")
def _(spark, d):
    """Objects of each scene: its own names where masks lie in folders, else the one foreground."""
    nation = table(spark, d, "nation")
    flat = spark.range(99, 100).select(F.col("id").cast(nation.schema["n_regionkey"].dataType).alias("scene"), F.lit(False).alias("nested"))
    scenes = nation.where("n_nationkey % 4 <> 0").groupBy(F.col("n_regionkey").alias("scene")).agg((F.count("*") > 5).alias("nested")).union(flat)
    named = nation.select("n_regionkey", "n_name")
    return scenes.join(named, F.col("nested") & (F.col("n_regionkey") == F.col("scene")), "left").select("scene", F.coalesce("n_name", F.lit("foreground")).alias("object"))


@query("frame_defaults", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [7, 8]::BIGINT[] ELSE range(0, doc_id % 4) END AS ids, list_sum(CASE WHEN doc_id % 3 = 0 THEN [0.5, 0.25]::DOUBLE[] ELSE list_transform(range(0, doc_id % 4), lambda q: 0.0::DOUBLE) END) AS score, (doc_id % 4)::BIGINT AS boxes FROM labels")
def _(spark, d):
    n = F.col("doc_id") % 4
    ids = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(7).cast("long"), F.lit(8).cast("long")))
    scores = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0.5), F.lit(0.25)))
    a, b, c = sl.frame_defaults(n, ids, scores, F.lit(None).cast("array<array<double>>"))
    total = F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x))
    return table(spark, d, "labels").select("doc_id", a.alias("ids"), total.alias("score"), F.size(c).cast("long").alias("boxes"))


PAIRS = (
    f"WITH {SQL['pixels']}, n AS (SELECT count(DISTINCT user_id) AS n FROM pixels), s AS (SELECT DISTINCT frame, user_id AS u, k FROM pixels, n WHERE {_u('user_id')} < 60.0 / n), "
    "e AS (SELECT vec_id AS id, list_transform(embedding[57:64], lambda q: q::DOUBLE) AS v FROM embeddings), p AS (SELECT frame, u, list(DISTINCT k) AS ks, any_value(v) AS v FROM s JOIN e ON e.id = u % 500 GROUP BY frame, u), "
    "c AS (SELECT frame, a.u AS a, b.u AS b, len(list_intersect(a.ks, b.ks)) > 0 AS same, list_dot_product(a.v, b.v) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-12)) AS cosine FROM p a JOIN p b USING (frame)), "
    "o AS (SELECT frame, b, bool_or(same) AS p, bool_or(same AND cosine < 0.75) AS hp, bool_or(NOT same) AS n, bool_or(NOT same AND cosine > 0.5) AS hn FROM c GROUP BY frame, b), "
    "t AS (SELECT c.*, p, hp, n, hn, greatest(cosine, 0) AS r FROM c JOIN o USING (frame, b) WHERE a < b) SELECT frame, "
    + ", ".join(
        f"round(coalesce((sum({loss}) FILTER ({of} AND {where})) / nullif(count(*) FILTER ({over}), 0), 0), 6) AS {name}"
        for name, loss, of, where, over in (
            ("hard_positive", "-cosine", "same", "cosine < 0.75", "same AND cosine < 0.75"), ("all_positive", "-cosine", "same", "p", "p"), ("soft_positive", "-cosine", "same", "hp", "hp"),
            ("hard_negative", "r", "NOT same", "cosine > 0.5", "NOT same AND cosine > 0.5"), ("all_negative", "r", "NOT same", "n", "n"), ("soft_negative", "r", "NOT same", "hn", "hn"),
        )
    )
    + " FROM t GROUP BY frame"
)


@query("pair_losses", PAIRS)
def _(spark, d):
    """Losses over pairs of about 60 sampled pixels, frame by frame: hard, all and soft, for and against."""
    p = pixels(spark, d)
    s = p.join(ev.sampled_keys(p, "user_id", 60), "user_id", "left_semi").select("frame", "user_id", "k").distinct()
    v = primitives(spark, d).select(F.col("id").alias("of"), "feats")
    losses = sl.pair_losses(sl.pair_features(s.join(v, F.col("user_id") % 500 == F.col("of")), "frame", "user_id", "k", "feats"), "frame")
    return losses.select("frame", *(f6(F.col(c)).alias(c) for c in ("hard_positive", "all_positive", "soft_positive", "hard_negative", "all_negative", "soft_negative")))


@query("running_gradients", "SELECT l_partkey, count(*) FILTER (l_quantity > 10) AS seen, round(sum(l_quantity) FILTER (l_quantity > 10), 4) AS total, round(coalesce(sum(l_quantity) FILTER (l_quantity > 10) / count(*) FILTER (l_quantity > 10), 0), 6) AS mean FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    """Sums and counts of gradient norms over the views that show a primitive, and their mean; 0 where none does."""
    q, seen = F.col("l_quantity").cast("double"), F.col("l_quantity") > 10
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(seen).alias("seen"), F.sum(F.when(seen, q)).alias("total"))
    return g.select("l_partkey", "seen", F.round("total", 4).alias("total"), f6(F.coalesce(F.try_divide("total", "seen"), F.lit(0.0))).alias("mean"))


@query("smoothed_losses", "WITH l AS (SELECT event_type, list(value ORDER BY ts, event_id) AS v, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, n, round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, x: 0.4 * x + 0.6 * a), 6) AS ema FROM l")
def _(spark, d):
    return sl.smoothed(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value").withColumn("ema", f6(F.col("ema")))


@query("first_primitives", PRIM + ", k AS (SELECT a.id AS id, pow(a.e[1]-b.e[1], 2) + pow(a.e[2]-b.e[2], 2) + pow(a.e[3]-b.e[3], 2) AS d2 FROM prim a JOIN prim b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d2, b.id) <= 3) SELECT id, round(ln(sqrt(greatest(avg(d2), 1e-7))), 6) AS scale, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, " + repr(round(math.log(0.1 / 0.9), 6)) + "::DOUBLE AS opacity FROM k GROUP BY id")
def _(spark, d):
    return sl.first_primitives(primitives(spark, d)).select("id", f6(F.col("scale")).alias("scale"), "w", "x", f6(F.col("opacity")).alias("opacity"))


@query("tokens_after_keys", "WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda q: q <> '') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN list_position(t, 'the') > 0 THEN t[list_position(t, 'the') + 1] END AS token FROM t")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sl.token_after(F.col("text"), "the").alias("token"))


@query("isolated_failures", "SELECT p_brand AS scene, count(*) FILTER (p_size % 7 <> 0) AS done, count(*) FILTER (p_size % 7 = 0) AS failed, round(avg(1.0::DOUBLE / (p_size % 7)) FILTER (p_size % 7 <> 0), 6) AS mean, min(p_partkey) FILTER (p_size % 7 = 0) AS first_failed FROM part GROUP BY ALL")
def _(spark, d):
    """Each job's value or failure; failures are gathered and the others go on."""
    jobs = table(spark, d, "part").select(F.col("p_brand").alias("scene"), "p_partkey", F.try_divide(F.lit(1.0), (F.col("p_size") % 7).cast("double")).alias("value"))
    return jobs.groupBy("scene").agg(F.count("value").alias("done"), F.count_if(F.col("value").isNull()).alias("failed"), f6(F.avg("value")).alias("mean"), F.min(F.when(F.col("value").isNull(), F.col("p_partkey"))).alias("first_failed"))
