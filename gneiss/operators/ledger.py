"""Analytics over ledgers of runs, parameter sweeps and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.storage import materialise


def mode_gain(runs: DataFrame, keys: list[str], metric: str = "metric", mode: str = "mode", of: str = "greedy_union", over: str = "best_cluster") -> DataFrame:
    """Best metric of one mode less that of another for the same keys; null where one is missing."""
    per_key = runs.groupBy(*keys).agg(F.max(F.when(F.col(mode) == of, F.col(metric))).alias("of"), F.max(F.when(F.col(mode) == over, F.col(metric))).alias("over"), F.count("*").alias("n"))
    return per_key.withColumn("gain", F.col("of") - F.col("over"))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group; the ranking keeps one row a task and group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def zip_sweep(spark, **values: list) -> DataFrame:
    """One row for each position of the lists; lists of one value serve all positions.

    Lists of other, unequal lengths are an error.
    """
    lengths = {len(v) for v in values.values()} - {1}
    if len(lengths) > 1 or 0 in lengths:
        raise ValueError(f"lists of lengths {sorted(lengths)} cannot be zipped")
    n = lengths.pop() if lengths else 1
    rows = [{k: v[0] if len(v) == 1 else v[i] for k, v in values.items()} | {"at": i} for i in range(n)]
    return spark.createDataFrame(rows)


def grid_sweep(tables: list[DataFrame]) -> DataFrame:
    """All combinations of small tables of values; the last varies fastest."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(F.broadcast(t))
    return out


def one_factor_slice(grid: DataFrame, best: DataFrame, factors: list[str]) -> DataFrame:
    """Rows of the grid that differ from the best row in at most one factor, null-safe."""
    b = best.select(*(F.col(f).alias(f"_{f}") for f in factors))
    differing = sum(((~F.col(f).eqNullSafe(F.col(f"_{f}"))).cast("int") for f in factors), F.lit(0))
    return grid.crossJoin(F.broadcast(b)).withColumn("changed", differing).where("changed <= 1").select(grid.columns + ["changed"])


def leave_one_out(rows: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Each row's part in the mean, and the mean without it."""
    whole = rows.agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    v = F.col(value)
    out = rows.crossJoin(F.broadcast(whole))  # one row of sums
    return out.select(*key, (v / F.col("_n")).alias("part"), F.when(F.col("_n") > 1, (F.col("_sum") - v) / (F.col("_n") - 1)).alias("mean_without"))


def forward_fill(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row of its group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def ancestors(spark, nodes: DataFrame, match: Column, most: int = 12) -> DataFrame:
    """``(id, hit, hops)``: the nearest ancestor within ``most`` hops, itself
    included, for which ``match`` holds, over (id, parent).

    A hop is a join of the rows that have not hit yet with the nodes; each hop's
    rows are written, so there is no limit on how many a recursion may give.
    """
    nodes = materialise(nodes.select("id", "parent", match.alias("hit")), "anc-nodes")
    above = nodes.select(F.col("id").alias("up"), F.col("parent").alias("next"), F.col("hit").alias("is"))
    live = nodes.select(F.col("id").alias("start"), "id", "parent", "hit")
    steps = [live]
    for _ in range(int(most)):
        climbed = live.where("NOT hit").join(above, F.col("parent") == F.col("up")).where("id <> up")
        live = materialise(climbed.select("start", F.col("up").alias("id"), F.col("next").alias("parent"), F.col("is").alias("hit")), "anc-live")
        if live.isEmpty():
            break
        steps.append(live)
    found = [s.where("hit").select(F.col("start").alias("id"), F.col("id").alias("hit"), F.lit(hops).alias("hops")) for hops, s in enumerate(steps)]
    return reduce(DataFrame.union, found)


def slug(text: Column) -> Column:
    """Lower case, everything but letters and digits an underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "_"), F.lit("_"))


def value_tag(text: Column) -> Column:
    """A number's text for use in names: minus is m, point is p, trailing zeros and a trailing p go."""
    tagged = F.replace(F.replace(text, F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))
    return F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(tagged, F.lit("0")), F.lit("p"))).otherwise(tagged)


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits compare as numbers of up to 12 digits."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(\\d+|\\D+)"), F.lit(1)), lambda p: F.when(p.rlike("^\\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")
