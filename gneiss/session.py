"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "gneiss", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    UTC keeps timestamps comparable across engines; adaptive execution re-plans
    joins, splits skewed partitions and coalesces small ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a tiny single-file input over the cores, for operators that multiply rows.

    The number of partitions follows the session's parallelism, and the call is
    only worth its shuffle in front of quadratic or compute-heavy operators.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1))
