"""Queries of run records: reports and logs are composed from the tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions.safe import f6
from gneiss.operators import affinity as af
from gneiss.plans.carriers import SQL, primitives, runs
from gneiss.plans.graph import ROTATED
from gneiss.session import table
from gneiss.sources import clouds as cd
from gneiss.sources import records as rc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RUNS = f"WITH {SQL['runs']}"
PRIM = f"WITH {SQL['prim']}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def reports(spark, d):
    """A report of each supplier, as runs write them."""
    line = "# Run %s\n\nCommunities found: **%d**\n\n## Parameters\n\n| param | value |\n| --- | --- |\n| knn_k | %d |\n| sigma | %s |\n| knn_k | %d |\n\n## Notes\n| x | y |\n\n## Graph Stats (full)\n| stat | value |\n|---|---|\n| edges | %d |\n"
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    return s.select("s_suppkey", F.format_string(line, "s_name", k * 3, k % 7, F.col("s_nationkey").cast("string"), k % 11, k * 20).alias("text"))


@query("report_tables", "SELECT s_suppkey, * FROM (SELECT s_suppkey, unnest([{'part': 'params', 'name': 'knn_k', 'value': (s_suppkey % 11)::VARCHAR}, {'part': 'params', 'name': 'sigma', 'value': s_nationkey::VARCHAR}, {'part': 'graph', 'name': 'edges', 'value': (s_suppkey * 20)::VARCHAR}], recursive := true) FROM supplier)".replace("SELECT s_suppkey, * FROM (", "SELECT * FROM ("))
def _(spark, d):
    return rc.report_tables(reports(spark, d), "s_suppkey", {"Parameters": "params", "Graph Stats": "graph"})


@query("report_values", "SELECT s_suppkey, (s_suppkey * 3)::VARCHAR AS communities, NULL::VARCHAR AS resolution, s_nationkey % 2 = 0 AS boundary FROM supplier")
def _(spark, d):
    """Values that a run's report gives, with what its name says where the report is silent."""
    r = reports(spark, d).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    name = F.when(F.col("s_nationkey") % 2 == 0, "spectral_B-v_k20").otherwise("spectral_k20")
    told = F.nullif(F.regexp_extract("text", "Boundary: (true|false)", 1), F.lit("")).cast("boolean")
    return r.select("s_suppkey", rc.report_value(F.col("text"), "Communities found").alias("communities"), rc.report_value(F.col("text"), "Resolution parameter").alias("resolution"), F.coalesce(told, F.contains(name, F.lit("_B-"))).alias("boundary"))


@query("report_sections", "SELECT s_suppkey, '# A' || chr(10) || chr(10) || '## Timings - render' || chr(10) || chr(10) || s_suppkey || ' s' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || '## End' || chr(10) ELSE '' END AS text FROM supplier")
def _(spark, d):
    """Reports with a section of timings written twice: the second takes the place of the first, or comes at the end."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    old = F.when(k % 3 == 0, F.lit("\n\n## Timings - render\n\nold\nlines\n")).otherwise("")
    text = F.concat(F.lit("# A"), F.when(k % 2 == 0, F.concat(F.when(k % 3 == 0, old).otherwise("\n\n## Timings - render\n"), F.lit("\n## End\n"))).otherwise(old))
    once = rc.with_section(text, F.lit("Timings - render"), F.lit("first"))
    return s.select("s_suppkey", rc.with_section(once, F.lit("Timings - render"), F.concat(k.cast("string"), F.lit(" s\n\n"))).alias("text"))


@query("tau_status", "WITH e AS (SELECT (user_id % 6) * 5 AS t, * FROM events), l AS (SELECT t, count(*) FILTER (event_id % 4 = 0) AS done, count(*) FILTER (event_id % 9 = 0) AS failed FROM e WHERE t <> 10 GROUP BY t), r AS (SELECT t, count(DISTINCT event_type) AS rendered FROM e WHERE t < 20 GROUP BY t) SELECT lpad(t::VARCHAR, 3, '0') AS tag, round(t / 100, 6) AS tau, coalesce(rendered, 0) AS rendered, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed FROM r FULL JOIN l USING (t)")
def _(spark, d):
    """What was rendered, done and failed by the threshold in log names."""
    e = table(spark, d, "events").withColumn("t", (F.col("user_id") % 6) * 5)
    tag = F.lpad(F.col("t").cast("string"), 3, "0")
    text = F.concat(F.lit("start\n"), F.when(F.col("event_id") % 4 == 0, "[done] ok\n").otherwise(""), F.when(F.col("event_id") % 9 == 0, "RuntimeError: no\n").otherwise(""))
    logs = e.select(F.when(F.col("t") != 10, F.concat(F.lit("/logs/x_tau"), tag, F.lit(".log"))).otherwise("/logs/other.log").alias("path"), text.alias("text"))
    rendered = e.where("t < 20").select(tag.alias("tag"), F.col("event_type").alias("scene"))
    return rc.tau_status(rendered, logs).withColumn("tau", f6(F.col("tau")))


NAMED = RUNS + ", n AS (SELECT scene, run, 'leiden_' || clusterer || '_k' || run_id || CASE WHEN run % 5 = 0 THEN '_B-v' ELSE '' END || '_' || run AS name, run % 97 AS modified FROM runs)"


def _named(spark, d):
    r = runs(spark, d)
    name = F.concat(F.lit("leiden_"), "clusterer", F.lit("_k"), F.col("run_id").cast("string"), F.when(F.col("run") % 5 == 0, "_B-v").otherwise(""), F.lit("_"), F.col("run").cast("string"))
    return r.select("scene", "run", name.alias("name"), (F.col("run") % 97).alias("modified"))


@query("runs_by_tokens", NAMED + " SELECT scene, name FROM n WHERE contains(name, '_k3') AND contains(name, 'B-v') QUALIFY row_number() OVER (PARTITION BY scene ORDER BY modified DESC, name DESC) = 1")
def _(spark, d):
    return rc.matching_run(_named(spark, d), "scene", "name", "modified", F.array(F.lit("_k3"), F.lit("B-v")))


@query("chosen_runs", NAMED + ", c AS (SELECT scene, name, name LIKE '%\\_7' ESCAPE '\\' OR name LIKE '%\\_11' ESCAPE '\\' AS w FROM n WHERE run % 3 <> 0 AND name LIKE 'leiden\\_1%' ESCAPE '\\') SELECT scene, arg_max(name, (coalesce((scene < 'M' AND name LIKE '%\\_7' ESCAPE '\\') OR (scene >= 'M' AND name LIKE '%\\_11' ESCAPE '\\'), false), name)) AS name FROM c GROUP BY scene")
def _(spark, d):
    n = _named(spark, d).withColumn("path", F.concat(F.when(F.col("run") % 3 == 0, "/out/ablation_x/").otherwise("/out/main/"), "name")).withColumn("suffix", F.when(F.col("scene") < "M", "7").otherwise("11"))
    return rc.chosen_run(n, "scene", "path", "leiden_1", "suffix")


@query("last_iterations", RUNS + " SELECT scene, max(run) FILTER (run % 4 <> 0) AS iteration, count(*) FILTER (run % 4 = 0) AS others FROM runs GROUP BY scene")
def _(spark, d):
    name = F.concat(F.lit("iteration_"), F.when(F.col("run") % 4 == 0, "x").otherwise(F.col("run").cast("string")))
    n = runs(spark, d).select("scene", rc.last_number(name).cast("long").alias("n"))
    return n.groupBy("scene").agg(F.max("n").alias("iteration"), F.count_if(F.col("n").isNull()).alias("others"))


@query("first_existing_paths", "WITH c AS (SELECT p_partkey, unnest([{'rank': 0, 'path': p_partkey * 2}, {'rank': 1, 'path': p_partkey + 1}, {'rank': 2, 'path': p_partkey}], recursive := true) FROM part) SELECT p_partkey, arg_min(CASE WHEN s_suppkey IS NOT NULL THEN '/p/' || path END, rank) AS path FROM c LEFT JOIN supplier ON s_suppkey = path GROUP BY p_partkey".replace("arg_min(CASE WHEN s_suppkey IS NOT NULL THEN '/p/' || path END, rank)", "min_by('/p/' || path, rank) FILTER (s_suppkey IS NOT NULL)"))
def _(spark, d):
    k = F.col("p_partkey")
    c = table(spark, d, "part").select("p_partkey", F.posexplode(F.transform(F.array(k * 2, k + 1, k), lambda x: F.concat(F.lit("/p/"), x.cast("string")))).alias("rank", "path"))
    there = table(spark, d, "supplier").select(F.concat(F.lit("/p/"), F.col("s_suppkey").cast("string")).alias("path"))
    return rc.first_existing(c, there, "p_partkey")


@query("mask_layouts", "SELECT n_name AS scene, n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0 AS nested FROM nation JOIN (SELECT DISTINCT c_nationkey FROM customer) ON c_nationkey = n_nationkey")
def _(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey").cast("string")
    inside = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("object/"), key, F.lit(".png"))).otherwise("notes.txt")
    beside = F.when(F.col("n_nationkey") % 3 == 0, F.concat(key, F.lit(".PNG"))).otherwise("notes.txt")
    return rc.layout(c.select(F.col("n_name").alias("scene"), F.explode(F.array(inside, beside)).alias("relative")), "scene")


@query("image_sizes", "SELECT p_partkey, (p_size * 80 / 4)::BIGINT AS quarter, floor((p_size * 80) / CASE WHEN p_size * 80 > 1600 THEN p_size * 80 / 1600.0::DOUBLE ELSE 1 END)::BIGINT AS most, floor(p_size * 30 / (p_size * 80 / 500.0::DOUBLE))::BIGINT AS fixed FROM part")
def _(spark, d):
    w, h = F.col("p_size") * 80, F.col("p_size") * 30
    p = table(spark, d, "part")
    return p.select("p_partkey", rc.image_size(w, h, 4)[0].alias("quarter"), rc.image_size(w, h, -1)[0].alias("most"), rc.image_size(w, h, 500)[1].alias("fixed"))


@query("metric_lookups", RUNS + " SELECT scene, run, CASE WHEN run % 3 <> 0 THEN round(metric, 4) END AS miou, CASE WHEN run % 4 <> 0 THEN run_id END AS best, coalesce(CASE WHEN run % 5 = 0 THEN round(metric * 2, 4) END, CASE WHEN run % 3 <> 0 THEN round(metric, 4) END) AS greedy FROM runs")
def _(spark, d):
    """Single values from a run's result files; those that a file does not have are null, the greedy score falls back to the plain one."""
    r = runs(spark, d)
    number = lambda c: F.round(c, 4).cast("string")
    plain = F.concat(F.lit('{"k": 1'), F.when(F.col("run") % 3 != 0, F.concat(F.lit(', "mIoU": '), number(F.col("metric")))).otherwise(""), F.when(F.col("run") % 4 != 0, F.concat(F.lit(', "best": {"cluster": '), F.col("run_id").cast("string"), F.lit("}"))).otherwise(""), F.lit("}"))
    greedy = F.when(F.col("run") % 5 == 0, F.concat(F.lit('{"mIoU": '), number(F.col("metric") * 2), F.lit("}")))
    at = lambda text, path: F.get_json_object(text, path)
    miou = at(plain, "$.mIoU").cast("double")
    return r.select("scene", "run", miou.alias("miou"), at(plain, "$.best.cluster").cast("long").alias("best"), F.coalesce(at(greedy, "$.mIoU").cast("double"), miou).alias("greedy"))


@query("scene_datasets", RUNS + ", s AS (SELECT DISTINCT scene FROM runs) SELECT scene, coalesce(r_name, 'unknown') AS dataset, CASE WHEN n_nationkey % 2 = 0 THEN 'misc/' || scene WHEN n_nationkey % 3 = 0 THEN 'interp/' || scene END AS folder FROM s LEFT JOIN nation ON n_name = scene LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 4")
def _(spark, d):
    """Dataset and folder of each scene; misc is looked at before interp."""
    s = runs(spark, d).select("scene").distinct().join(table(spark, d, "nation"), F.col("n_name") == F.col("scene"), "left")
    s = s.join(table(spark, d, "region").where("r_regionkey <> 4"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    folder = F.coalesce(*(F.when(F.col("n_nationkey") % n == 0, F.concat(F.lit(f"{at}/"), "scene")) for n, at in ((2, "misc"), (3, "interp"))))
    return s.select("scene", F.coalesce("r_name", F.lit("unknown")).alias("dataset"), folder.alias("folder"))


@query("segmented_colours", PRIM + ", c AS (SELECT id, label % 17 AS c, e FROM prim) SELECT id, c, ((c * 97 + 13) % 256)::INT AS red, round((((c * 97 + 13) % 256) / 255.0::DOUBLE - 0.5) / 0.28209479177387814, 6) AS f_dc_0, 0.0::DOUBLE AS f_rest_0, round(e[14], 6) AS opacity FROM c")
def _(spark, d):
    """Points with their cluster's colour in place of their own, and without the rest of their harmonics."""
    p = primitives(spark, d).select("id", F.col("label").alias("cls"), F.get("f_dc", 0).alias("f_dc_0"), F.get("f_dc", 1).alias("f_dc_1"), F.get("f_dc", 2).alias("f_dc_2"), F.get("feats", 0).alias("f_rest_0"), "opacity", F.lit(1).alias("nx"))
    palette = [((97 * c + 13) % 256, (57 * c + 101) % 256, (31 * c + 7) % 256) for c in range(17)]
    out = cd.segmented(p, palette)
    return out.select("id", (F.col("cls") % 17).cast("int").alias("c"), F.col("red").cast("int").alias("red"), f6(F.col("f_dc_0")).alias("f_dc_0"), "f_rest_0", f6(F.col("opacity")).alias("opacity"))


@query("camera_records", ROTATED + " SELECT id, 'view_' || id AS name, round(-(r00*e[4] + r01*e[5] + r02*e[6]), 6) AS x, round(r21, 6) AS r21, round(200 / (2 * tan((0.6 + abs(e[1])) / 2)), 6) AS fx FROM r")
def _(spark, d):
    """Cameras as JSON records, read again."""
    r, t = af.rotation_rows(F.col("rot")), [F.get("f_dc", i) for i in range(3)]
    text = rc.camera_json(F.col("id"), F.concat(F.lit("view_"), F.col("id").cast("string")), (F.lit(200), F.lit(100)), r, t, (0.6 + F.abs("x"), 0.8 + F.abs("y")))
    c = primitives(spark, d).select(F.from_json(text, "id long, img_name string, position array<double>, rotation array<array<double>>, fx double").alias("c"))
    return c.select("c.id", F.col("c.img_name").alias("name"), f6(F.get("c.position", 0)).alias("x"), f6(F.get(F.get("c.rotation", 2), 1)).alias("r21"), f6(F.col("c.fx")).alias("fx"))


@query("id_map_rows", f"WITH {SQL['pixels']}, g AS (SELECT user_id % 3 AS plane, y, x, min(k) AS k FROM pixels GROUP BY ALL), f AS (SELECT plane, ys.y::INT AS y, list(coalesce(k, 0) ORDER BY xs.x) AS ks FROM (SELECT DISTINCT plane FROM g) CROSS JOIN (SELECT unnest(range(0, 50)) AS y) ys CROSS JOIN (SELECT unnest(range(0, 50)) AS x) xs LEFT JOIN g USING (plane, y, x) GROUP BY ALL) SELECT plane, y, list_aggregate(list_transform(ks, lambda q: printf('%02X', q)), 'string_agg', '') AS bytes FROM f")
def _(spark, d):
    """Id maps as rows of bytes, 0 where no cluster is seen."""
    from gneiss.plans.carriers import pixels

    g = pixels(spark, d).groupBy((F.col("user_id") % 3).alias("plane"), "y", "x").agg(F.min("k").alias("k"))
    return cd.id_map_rows(g, ["plane"], 50, 50).select("plane", "y", F.hex("bytes").alias("bytes"))


@query(
    "provenance_rows",
    "WITH s AS (SELECT s_suppkey AS k, s_nationkey AS nk FROM supplier), u AS (SELECT *, 'global' AS family, 'full' AS variant FROM s UNION ALL SELECT *, 'ablation', 'no_geo' FROM s WHERE k % 3 = 0) "
    "SELECT CASE WHEN nk % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, family, variant, k AS scene, CASE WHEN k % 5 <> 0 THEN 'gpu' || (k % 2) ELSE '--' END AS device, "
    "CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN (k * 10)::VARCHAR ELSE '--' END AS n_valid, '--' AS resolution, CASE WHEN k % 4 <> 0 THEN (k * 3)::VARCHAR ELSE '--' END AS communities, '--' AS modularity_q, "
    "CASE WHEN k % 4 <> 0 THEN 'knn_k=' || (k % 11) || '; sigma=' || nk ELSE 'knn_k=--; sigma=--' END || '; use_geometry=' || (CASE WHEN variant = 'no_geo' THEN 'False' ELSE 'True' END) AS params, "
    "CASE WHEN k % 4 <> 0 THEN 'edges=' || (k * 20) || '; nnz=--' ELSE '--' END AS graph, "
    "CASE WHEN k % 5 <> 0 THEN 'spectral.build=' || printf('%.3f', k / 4) || 's; spectral_total_s=' || printf('%.3f', k / 2) || 's' ELSE '--' END AS timing, 'out/s' || k AS run FROM u",
)
def _(spark, d):
    """Runs of two families with what their reports and timings, where there are any, say."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    run = rc.base_run(F.concat(F.lit("out/s"), k, F.lit("/objectness_long/cluster_ids_train")))
    rows = lambda family, variant: s.select(F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("dataset"), F.lit(family).alias("family"), F.lit(variant).alias("variant"), k.alias("scene"), run.alias("run"))
    written = reports(spark, d).where(k % 4 != 0).select(F.concat(F.lit("out/s"), k).alias("run"), "text")
    build = F.create_map(F.lit("build"), k / 4, F.lit("other"), F.lit(1.0))
    told = F.to_json(F.struct(F.concat(F.lit("gpu"), k % 2).alias("device"), F.when(k % 2 == 0, k * 10).alias("n_valid_gaussians"), build.alias("spectral"), (k / 2).alias("spectral_total_s")))
    timings = s.where(k % 5 != 0).select(F.concat(F.lit("out/s"), k).alias("run"), told.alias("text"))
    both = rows("global", "full").unionByName(rows("ablation", "no_geo").where("scene % 3 = 0"))
    return rc.provenance(both, written, timings, ["knn_k", "sigma", "use_geometry"], ["edges", "nnz"], ["spectral.build", "spectral.cut", "spectral_total_s"])
