"""The driver's tables in the roles of the engine's own tables.

Each function gives a DataFrame; the string of the same name in ``SQL`` is the
common table expression that gives DuckDB the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.session import table

SQL = {
    "prim": "prim AS (SELECT vec_id AS id, list_transform(embedding, lambda q: q::DOUBLE) AS e, label + 1 AS label FROM embeddings)",
    "types": "types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events))",
    "pixels": (
        "types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)), "
        "pixels AS (SELECT cast(ts AS date) AS frame, event_id AS pixel, event_id % 50 AS y, (event_id // 50) % 50 AS x, user_id, k, value > 20 AS gt, value "
        "FROM events JOIN types USING (event_type))"
    ),
    "runs": (
        "runs AS (SELECT n_name AS scene, o_orderpriority AS clusterer, o_custkey % 7 AS run_id, "
        "CASE o_orderstatus WHEN 'F' THEN 'best_cluster' WHEN 'O' THEN 'greedy_union' ELSE 'other' END AS mode, o_totalprice AS metric, o_orderkey AS run "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
    ),
}


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with attributes cut from a 64-number vector."""
    e = F.col("embedding")
    part = lambda a, n: F.transform(F.slice(e, a, n), lambda q: q.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        *(F.get(e, i).cast("double").alias(c) for i, c in enumerate("xyz")),
        part(4, 3).alias("f_dc"),
        part(7, 3).alias("scale"),
        part(10, 4).alias("rot"),
        F.get(e, 13).cast("double").alias("opacity"),
        part(15, 18).alias("traj"),
        part(33, 24).alias("dquat"),
        part(57, 8).alias("feats"),
        (F.col("label") + 1).alias("label"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pixels: frame, pixel, y, x, user_id, predicted cluster k, mask gt, value."""
    events = table(spark, sf_dir, "events")
    names = F.array_sort(F.collect_set("event_type"))
    types = events.agg(names.alias("names")).select(F.posexplode("names").alias("at", "type")).select((F.col("at") + 1).cast("long").alias("k"), "type")
    return events.join(F.broadcast(types), F.col("event_type") == F.col("type")).select(
        F.to_date("ts").alias("frame"),
        F.col("event_id").alias("pixel"),
        (F.col("event_id") % 50).alias("y"),
        (F.floor(F.col("event_id") / 50) % 50).alias("x"),
        "user_id",
        "k",
        (F.col("value") > 20).alias("gt"),
        "value",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of runs: scene, clusterer, run_id, mode, metric, run."""
    mode = F.when(F.col("o_orderstatus") == "F", "best_cluster").when(F.col("o_orderstatus") == "O", "greedy_union").otherwise("other")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("scene"), F.col("o_orderpriority").alias("clusterer"), (F.col("o_custkey") % 7).alias("run_id"), mode.alias("mode"),
            F.col("o_totalprice").alias("metric"), F.col("o_orderkey").alias("run"),
        )
    )
