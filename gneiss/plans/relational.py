"""Set operations, joins with missing sides, ordering, and keep-first selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions.safe import f6
from gneiss.operators.ledger import first_by
from gneiss.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("union_families", "SELECT 'customer' AS family, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("family"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("family"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return a.unionByName(b)


@query("frames_in_both", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("frames_missing", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@query("semi_and_anti", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS funded FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    funded = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.lit(True).alias("yes"))
    left = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return left.join(funded, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("yes", F.lit(False)).alias("funded"))


@query("exact_duplicates_keep_first", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(spark, d):
    # Smallest id of each digest: an aggregate that combines before the shuffle, so a text with many copies is one row a task.
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("full_outer_ids", "SELECT coalesce(l.doc_id, b.item_id) AS id, l.toxic IS NOT NULL AS labelled, b.item_id IS NOT NULL AS listed FROM labels l FULL JOIN benchmark b ON l.doc_id = b.item_id")
def _(spark, d):
    l, b = table(spark, d, "labels"), table(spark, d, "benchmark")
    return l.join(b, l.doc_id == b.item_id, "full").select(F.coalesce("doc_id", "item_id").alias("id"), F.col("toxic").isNotNull().alias("labelled"), F.col("item_id").isNotNull().alias("listed"))


@query("left_join_defaults", "SELECT n_name, coalesce(s.n, 0) AS suppliers, coalesce(s.first_name, '') AS first_name FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_name) AS first_name FROM supplier GROUP BY ALL) s ON s_nationkey = n_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_name").alias("first_name"))
    return table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("suppliers"), F.coalesce("first_name", F.lit("")).alias("first_name"))


@query("fallback_merge", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END), ''), 'baseline') AS tag, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, -1) AS v FROM customer")
def _(spark, d):
    tag = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    json = F.when(F.col("c_custkey") % 2 == 0, F.map_from_arrays(F.array(F.lit("v")), F.array("c_acctbal"))).otherwise(F.map_from_arrays(F.array(F.lit("none")), F.array(F.lit(0.0))))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(F.map_from_arrays(F.array(F.lit("v")), F.array(F.lit(-1.0)))), lambda e: ~F.map_contains_key(json, "v")), F.map_entries(json)))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(F.trim(tag), F.lit("")), F.lit("baseline")).alias("tag"), F.try_element_at(merged, F.lit("v")).alias("v"))


@query("latest_run", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"))


@query("last_row_wins", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) = 1")
def _(spark, d):
    return first_by(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], F.col("l_linenumber").desc(), F.col("l_partkey"))


@query("dense_labels", "SELECT DISTINCT l_partkey % 100 * 7 AS label, dense_rank() OVER (ORDER BY l_partkey % 100 * 7) - 1 AS dense FROM lineitem")
def _(spark, d):
    labels = table(spark, d, "lineitem").select((F.col("l_partkey") % 100 * 7).alias("label")).distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("dense"))


@query("eigengap", "WITH v AS (SELECT l_linenumber AS i, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), r AS (SELECT i, v, v - lead(v) OVER (ORDER BY v DESC, i) AS gap FROM v) SELECT i, round(gap, 6) AS gap, row_number() OVER (ORDER BY round(gap, 9) DESC NULLS LAST, i) AS rank FROM r")
def _(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("i")).agg(F.avg("l_quantity").alias("v"))
    r = v.select("i", (F.col("v") - F.lead("v").over(Window.orderBy(F.col("v").desc(), "i"))).alias("gap"))  # one row an eigenvalue
    return r.select("i", f6(F.col("gap")).alias("gap"), F.row_number().over(Window.orderBy(F.round("gap", 9).desc_nulls_last(), "i")).cast("long").alias("rank"))


@query("sorted_summary_top", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10")
def _(spark, d):
    l, s, n = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    joined = l.select("l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue")).orderBy(F.col("revenue").desc(), "n_name").limit(10)


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS base, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def _(spark, d):
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("base"), f6(F.avg("l_discount")).alias("discount"))


@query("moving_average", "SELECT event_id, round(0.4 * value + 0.6 * coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value), 6) AS smooth FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", f6(0.4 * F.col("value") + 0.6 * F.coalesce(F.lag("value").over(w), F.col("value"))).alias("smooth"))


@query("tumbling_peaks", "SELECT date_trunc('hour', ts) AS start, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))


@query("sessions", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, s::BIGINT AS session, count(*) AS n, min(ts) AS start FROM s GROUP BY ALL")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    s = table(spark, d, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"))
