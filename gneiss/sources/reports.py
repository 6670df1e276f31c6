"""Sinks for small result tables: keyed upserts, summaries in CSV, Markdown and TeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.ordering import positions

#: A report holds no more rows than this; a longer table raises.
MOST_ROWS = 100_000


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``fresh`` in place of those with the same keys."""
    return existing.join(fresh.select(keys).distinct(), keys, "left_anti").unionByName(fresh)


def write_summary(df: DataFrame, path: str, columns: list[str], order: list[str], rounded: list[str], places: int = 4) -> None:
    """One CSV file with fixed columns, sorted, nulls first as empty text, measures rounded."""
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a summary of more than {MOST_ROWS} rows")
    kept = df.select(*(F.round(c, places).alias(c) if c in rounded else F.col(c) for c in columns))
    kept.orderBy(*(F.col(c).asc_nulls_first() for c in order)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def _small(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows")
    return rows


def write_json_results(df: DataFrame, path: str, name: str) -> None:
    """One JSON file ``<name>.json`` a row, of its other columns; nulls are written as null.  A name may not come twice."""
    from gneiss.sources.members import register, write_files

    register(df.sparkSession)
    content = F.to_json(F.struct(*(F.col(c) for c in df.columns if c != name)), {"ignoreNullFields": "false"}).cast("binary")
    named = df.select(F.concat(F.col(name).cast("string"), F.lit(".json")).alias("file"), content.alias("content"))
    once = F.when(F.count("*").over(Window.partitionBy("file")) == 1, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("two results named "), F.col("file"))).cast("binary"))
    write_files(named.select("file", once.alias("content")), path)


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Columns with their defaults where they are null, or where the table does not have them."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def _cell(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown_table(df: DataFrame) -> str:
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(_cell(v).replace("|", "\\|") for v in r) + " |" for r in _small(df)])


def tex_text(text: Column) -> Column:
    """Text as TeX prints it: signs that TeX reads as commands are marked or named."""
    marked = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\x01")), "([&%$#_{}])", "\\\\$1")
    named = {"\x01": "backslash", "~": "asciitilde", "^": "asciicircum"}
    for sign, name in named.items():
        marked = F.replace(marked, F.lit(sign), F.lit(f"\\text{name}{{}}"))
    return marked


def tex_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``(at, line)``: one line of a TeX table a row, in order; numbers to four places."""
    cell = lambda c: F.format_string("%.4f", F.col(c)) if df.schema[c].dataType.simpleString() in ("double", "float") else tex_text(F.col(c).cast("string"))
    cells = [F.coalesce(F.when(F.col(c).isNotNull(), cell(c)), F.lit("")) for c in df.columns]
    return positions(df, order).select("at", F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))
