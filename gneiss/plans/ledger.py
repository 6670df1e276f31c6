"""Queries over run ledgers, sweeps and reports; ``orders`` carries the runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions.safe import f6
from gneiss.operators import ledger as lg
from gneiss.operators.ordering import positions
from gneiss.plans.carriers import SQL, runs
from gneiss.session import table
from gneiss.sources.reports import tex_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RUNS = f"WITH {SQL['runs']}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("greedy_gain", RUNS + " SELECT scene, clusterer, run_id, count(*) AS n, round(max(metric) FILTER (mode = 'greedy_union') - max(metric) FILTER (mode = 'best_cluster'), 6) AS gain FROM runs GROUP BY ALL")
def _(spark, d):
    return lg.mode_gain(runs(spark, d), ["scene", "clusterer", "run_id"]).select("scene", "clusterer", "run_id", "n", f6(F.col("gain")).alias("gain"))


@query("group_summary", RUNS + " SELECT scene, mode, count(*) AS n, round(sum(round(metric * 100)::BIGINT)::DOUBLE / count(*) / 100, 4) AS mean, round(min(metric), 4) AS low, round(max(metric), 4) AS high, round((sum(round(metric * 100)::BIGINT) FILTER (run_id > 2))::DOUBLE / count(*) FILTER (run_id > 2) / 100, 4) AS late FROM runs GROUP BY ALL")
def _(spark, d):
    m, late = F.col("metric"), F.col("run_id") > 2
    cents = F.round(m * 100).cast("long")  # whole numbers: the sum has no order
    mean = lambda total, n: F.round(F.try_divide(total.cast("double"), n) / 100, 4)
    return runs(spark, d).groupBy("scene", "mode").agg(
        F.count("*").alias("n"), mean(F.sum(cents), F.count("*")).alias("mean"), F.round(F.min(m), 4).alias("low"), F.round(F.max(m), 4).alias("high"), mean(F.sum(F.when(late, cents)), F.count_if(late)).alias("late")
    )


@query("variant_delta", RUNS + ", v AS (SELECT clusterer, avg(metric) AS mean, count(*) FILTER (mode <> 'other') AS done FROM runs GROUP BY clusterer), b AS (SELECT mean AS base FROM v ORDER BY clusterer LIMIT 1) SELECT clusterer, done, round(mean, 4) AS mean, round(mean - base, 4) AS delta FROM v, b")
def _(spark, d):
    v = runs(spark, d).groupBy("clusterer").agg(F.avg("metric").alias("mean"), F.count_if(F.col("mode") != "other").alias("done"))
    base = v.agg(F.min_by("mean", "clusterer").alias("base"))
    return v.crossJoin(F.broadcast(base)).select("clusterer", "done", F.round("mean", 4).alias("mean"), F.round(F.col("mean") - F.col("base"), 4).alias("delta"))


@query("best_run_per_scene", RUNS + " SELECT scene, run, metric FROM runs QUALIFY row_number() OVER (PARTITION BY scene ORDER BY metric DESC, run) = 1")
def _(spark, d):
    return lg.first_by(runs(spark, d).select("scene", "run", "metric"), ["scene"], F.col("metric").desc(), F.col("run"))


@query("run_ranks", RUNS + " SELECT scene, run, row_number() OVER (PARTITION BY scene ORDER BY metric DESC, run) AS rank FROM runs")
def _(spark, d):
    rank = F.row_number().over(Window.partitionBy("scene").orderBy(F.col("metric").desc(), "run"))
    return runs(spark, d).select("scene", "run", rank.cast("long").alias("rank"))


@query("leave_one_out", RUNS + ", s AS (SELECT scene, avg(metric) AS m FROM runs GROUP BY scene) SELECT scene, round(m / count(*) OVER (), 6) AS part, round((sum(m) OVER () - m) / (count(*) OVER () - 1), 4) AS mean_without FROM s")
def _(spark, d):
    s = runs(spark, d).groupBy("scene").agg(F.avg("metric").alias("m"))
    return lg.leave_one_out(s, "m", ["scene"]).select("scene", f6(F.col("part")).alias("part"), F.round("mean_without", 4).alias("mean_without"))


@query("three_way_join", RUNS + ", s AS (SELECT scene, clusterer, max(metric) AS m FROM runs GROUP BY ALL) SELECT a.scene, round(a.m, 4) AS base, round(b.m, 4) AS merged, round(c.m, 4) AS tuned, round(c.m - a.m, 4) AS gain FROM s a JOIN s b USING (scene) JOIN s c USING (scene) WHERE a.clusterer = '1-URGENT' AND b.clusterer = '2-HIGH' AND c.clusterer = '3-MEDIUM'")
def _(spark, d):
    s = runs(spark, d).groupBy("scene").pivot("clusterer", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.max("metric"))
    a, b, c = (F.col(f"`{x}`") for x in ("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return s.where(a.isNotNull() & b.isNotNull() & c.isNotNull()).select("scene", F.round(a, 4).alias("base"), F.round(b, 4).alias("merged"), F.round(c, 4).alias("tuned"), F.round(c - a, 4).alias("gain"))


@query("mean_row_rollup", RUNS + " SELECT coalesce(scene, 'Mean') AS scene, round(avg(metric), 4) AS mean, count(*) AS n FROM runs GROUP BY ROLLUP (scene)")
def _(spark, d):
    return runs(spark, d).rollup("scene").agg(F.avg("metric").alias("mean"), F.count("*").alias("n")).select(F.coalesce("scene", F.lit("Mean")).alias("scene"), F.round("mean", 4).alias("mean"), "n")


@query("sweep_best_value", "WITH u AS (SELECT 'size' AS parameter, p_size::VARCHAR AS value, p_retailprice AS metric FROM part UNION ALL SELECT 'brand', p_brand, p_retailprice FROM part UNION ALL SELECT 'type', p_type, p_retailprice FROM part), m AS (SELECT parameter, value, avg(metric) AS mean FROM u GROUP BY ALL) SELECT parameter, value, round(mean, 4) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY parameter ORDER BY round(mean, 6) DESC, value) = 1")
def _(spark, d):
    u = table(spark, d, "part").select(F.expr("stack(3, 'size', cast(p_size as string), 'brand', p_brand, 'type', p_type) AS (parameter, value)"), F.col("p_retailprice").alias("metric"))
    m = u.groupBy("parameter", "value").agg(F.avg("metric").alias("mean"))
    return lg.first_by(m, ["parameter"], f6(F.col("mean")).desc(), F.col("value")).withColumn("mean", F.round("mean", 4))


GRID = "g AS (SELECT p_size AS a, p_brand AS b, p_type AS c, avg(p_retailprice) AS metric FROM part GROUP BY ALL), top AS (SELECT a AS a0, b AS b0, c AS c0 FROM g ORDER BY round(metric, 6) DESC, a, b, c LIMIT 1)"


@query("one_factor_slice", f"WITH {GRID} SELECT a, b, c, round(metric, 4) AS metric, (a <> a0)::INT + (b <> b0)::INT + (c <> c0)::INT AS changed FROM g, top WHERE (a <> a0)::INT + (b <> b0)::INT + (c <> c0)::INT <= 1")
def _(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_size").alias("a"), F.col("p_brand").alias("b"), F.col("p_type").alias("c")).agg(F.avg("p_retailprice").alias("metric"))
    top = g.orderBy(f6(F.col("metric")).desc(), "a", "b", "c").limit(1)
    return lg.one_factor_slice(g, top, ["a", "b", "c"]).withColumn("metric", F.round("metric", 4))


@query("grid_sweep", "WITH v AS (SELECT DISTINCT p_brand AS a FROM part), w AS (SELECT DISTINCT p_size % 3 AS b FROM part), n AS (SELECT DISTINCT n_name AS scene FROM nation) SELECT a, b, scene, (row_number() OVER (ORDER BY a, b, scene) - 1) % 2 AS worker FROM v, w, n")
def _(spark, d):
    part = table(spark, d, "part")
    values = part.select(F.col("p_brand").alias("a")).distinct(), part.select((F.col("p_size") % 3).alias("b")).distinct(), table(spark, d, "nation").select(F.col("n_name").alias("scene")).distinct()
    return positions(lg.grid_sweep(list(values)), ["a", "b", "scene"]).select("a", "b", "scene", (F.col("at") % 2).cast("long").alias("worker"))


@query("zip_sweep", "WITH b AS (SELECT list_sort(list(DISTINCT p_brand)) AS v FROM part), s AS (SELECT list_sort(list(DISTINCT r_name)) AS r FROM region) SELECT i AS at, v[i] AS brand, r[1] AS region FROM b, s, (SELECT unnest(range(1, 100)) AS i) WHERE i <= len(v)")
def _(spark, d):
    b = table(spark, d, "part").agg(F.array_sort(F.collect_set("p_brand")).alias("v"))
    s = table(spark, d, "region").agg(F.array_sort(F.collect_set("r_name")).alias("r"))
    z = b.crossJoin(F.broadcast(s)).select(F.posexplode(F.arrays_zip("v", F.array_repeat(F.get("r", 0), F.size("v")).alias("r"))).alias("i", "z"))
    return z.select((F.col("i") + 1).cast("long").alias("at"), F.col("z.v").alias("brand"), F.col("z.r").alias("region"))


@query("status_summary", RUNS + " SELECT scene, count(*) FILTER (mode = 'best_cluster') AS done, count(*) FILTER (mode = 'greedy_union') AS error, count(*) FILTER (mode = 'other') AS missing, round(avg(metric) FILTER (mode = 'best_cluster'), 4) AS mean_done FROM runs GROUP BY scene")
def _(spark, d):
    kinds = {"done": "best_cluster", "error": "greedy_union", "missing": "other"}
    done = F.when(F.col("mode") == "best_cluster", F.col("metric"))
    return runs(spark, d).groupBy("scene").agg(*(F.count_if(F.col("mode") == v).alias(k) for k, v in kinds.items()), F.round(F.avg(done), 4).alias("mean_done"))


@query("telemetry_peaks", "SELECT user_id % 2 AS gpu, event_type AS scene, count(*) AS samples, max(value) AS peak, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 2).alias("gpu"), F.col("event_type").alias("scene")).agg(F.count("*").alias("samples"), F.max("value").alias("peak"), f6(F.avg("value")).alias("mean"))


@query("stage_timers", "SELECT event_type AS stage, round(sum(value), 4) AS total_s, round(1e6 * sum(value) / (SELECT count(*) FROM embeddings), 3) AS us_per_point FROM events GROUP BY event_type")
def _(spark, d):
    points = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("s"))
    return t.crossJoin(F.broadcast(points)).select("stage", F.round("s", 4).alias("total_s"), F.round(1e6 * F.col("s") / F.col("n"), 3).alias("us_per_point"))


@query("ancestor_join", "WITH RECURSIVE n AS (SELECT p_partkey AS id, p_partkey // 2 AS parent, p_size >= 45 AS m FROM part), up(start, id, parent, hops, hit) AS (SELECT id, id, parent, 0, m FROM n UNION ALL SELECT up.start, n.id, n.parent, up.hops + 1, n.m FROM up JOIN n ON up.parent = n.id WHERE NOT up.hit AND up.hops < 12 AND up.id <> n.id) SELECT start AS id, id AS hit, hops FROM up WHERE hit")
def _(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("parent"), "p_size")
    return lg.ancestors(spark, nodes, F.col("p_size") >= 45)


@query("section_forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def _(spark, d):
    c = lg.forward_fill(table(spark, d, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "section")
    return c.select("conv_id", "turn", "section")


@query("report_fields", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'track\\((\\d+)\\)', 1) AS tracked, try_cast(regexp_extract(url, '/(\\d+)', 1) AS INT) AS number, CASE WHEN contains(url, '?') THEN 'query' WHEN ends_with(url, '.html') THEN 'file' ELSE 'path' END AS kind FROM pages")
def _(spark, d):
    h, u = F.col("html"), F.col("url")
    kind = F.when(F.contains(u, F.lit("?")), "query").when(F.endswith(u, F.lit(".html")), "file").otherwise("path")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, "track\\((\\d+)\\)", 1).alias("tracked"), F.regexp_extract(u, "/(\\d+)", 1).try_cast("int").alias("number"), kind.alias("kind"))


@query("trailing_index", "SELECT page_id, coalesce(try_cast(list_last(regexp_extract_all(url, '(\\d+)', 1)) AS BIGINT), 0) AS idx FROM pages")
def _(spark, d):
    runs_ = F.regexp_extract_all("url", F.lit("(\\d+)"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.coalesce(F.try_element_at(runs_, F.lit(-1)).try_cast("long"), F.lit(0)).alias("idx"))


@query("escaped_names", r"SELECT s_suppkey, replace(replace(regexp_replace(s_name || '_&~^' || s_acctbal::BIGINT, '([&%$#_{}])', '\\\1', 'g'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}') AS escaped FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", tex_text(F.concat("s_name", F.lit("_&~^"), F.bround("s_acctbal").cast("long").cast("string"))).alias("escaped"))


@query("name_slugs", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS slug, list_last(string_split(s_name, '#')) AS tail FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", lg.slug(F.col("s_name")).alias("slug"), F.element_at(F.split("s_name", "#"), -1).alias("tail"))


@query("value_tags", "SELECT s_suppkey, rtrim(rtrim(replace(replace(printf('%.2f', s_acctbal), '-', 'm'), '.', 'p'), '0'), 'p') AS tag FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", lg.value_tag(F.format_string("%.2f", "s_acctbal")).alias("tag"))


@query("natural_order", "SELECT c_custkey, concat('w', lpad((c_custkey % 1000)::VARCHAR, 12, '0'), 'x') AS key FROM customer")
def _(spark, d):
    name = F.concat(F.lit("w"), (F.col("c_custkey") % 1000).cast("string"), F.lit("x"))
    return table(spark, d, "customer").select("c_custkey", lg.natural_key(name).alias("key"))


@query("json_defaults", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events")
def _(spark, d):
    get = lambda key: F.coalesce(F.get_json_object("props", f"$.{key}"), F.lit("none"))
    return table(spark, d, "events").select("event_id", get("k").alias("k"), get("absent").alias("absent"))


@query("run_names", RUNS + " SELECT run, concat_ws('_', lower(scene), clusterer, 'r' || run_id, CASE WHEN mode = 'other' THEN NULL ELSE mode END) AS name, CASE WHEN starts_with(clusterer, '1') THEN 'urgent' WHEN starts_with(clusterer, '5') THEN 'low' ELSE 'mid' END AS family FROM runs")
def _(spark, d):
    family = F.when(F.startswith("clusterer", F.lit("1")), "urgent").when(F.startswith("clusterer", F.lit("5")), "low").otherwise("mid")
    name = F.concat_ws("_", F.lower("scene"), "clusterer", F.concat(F.lit("r"), F.col("run_id").cast("string")), F.when(F.col("mode") != "other", F.col("mode")))
    return runs(spark, d).select("run", name.alias("name"), family.alias("family"))
