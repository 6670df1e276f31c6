"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.storage import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
PIECE = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"
#: Above this many sources their table is joined by shuffling, not broadcast.
BROADCAST_SOURCES = 10_000


def letter_share(text: Column) -> Column:
    """A document's quality weight: 0.1 plus the share of letters and blanks among its characters."""
    symbols = F.length(F.regexp_replace(text, "[\\p{L} ]", ""))
    return F.coalesce(F.lit(1.1) - symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0.1))


def uniform(key: Column) -> Column:
    """A repeatable uniform variate in (0, 1) for each key, from 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds each source's ``target`` to a table of ``(source, source_size)``.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all sizes by weight.  No target exceeds ``most`` times its
    source's size; what is over goes to the others by weight.  In order of
    ``size / weight`` the capped sources come first, so the level at which the
    rest is filled follows from running sums.  The windows here run over one
    row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", turn).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights_left"),
    )
    ranked = ranked.withColumn("level", F.col("left") / F.col("weights_left"))
    # The first source in this order that is not capped sets the level for all after it.
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everyone)["level"]
    return ranked.select("source", "source_size", F.round(F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")), 6).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    quality: Column | None = None,
    strata: int = 8192,
    carry: bool = False,
) -> DataFrame:
    """``(id_col, size, source_size, target, taken)`` for every row; with ``carry``
    also ``row``, a struct of all its columns.

    ``size`` is the number of words.  A source whose target holds its size n
    times over is taken n times whole; the rest of the target goes to its
    documents in the order of their keys ``-ln(u) / quality``, where u is a
    repeatable uniform variate of the id: a weighted sample without
    replacement.  The document at the end of the budget gives only its first
    words, so the words taken equal the target rounded to a whole number.

    A source is never put in one task: keys fall in ordered strata by their
    logarithm, ``strata`` of them for a factor of e, whose sizes are summed with
    map-side combine; strata wholly inside or outside the budget are decided by
    their sums, and only the one stratum that the budget ends in is sorted.  A
    quality only shifts the logarithm of a key, whose density is nowhere above
    1 / e, so whatever the qualities are no stratum is expected to have more
    than 1 / (e * strata) of its source's rows.  The table of sources is broadcast up to
    ``BROADCAST_SOURCES`` rows and joined by shuffling above.

    Null text has size 0; a null source is a source of its own; a null id has
    the key of the empty string; repeated ids share a key and are then ordered
    by size and text hash, equal rows arbitrarily but with equal sums.  An empty
    table gives an empty result; documents whose quality is null or 0 come last.
    Other columns play no part.
    """
    text = F.col(text_col)
    weight = letter_share(text) if quality is None else quality
    key = -F.log(uniform(F.col(id_col))) / weight
    sized = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            F.xxhash64(text).alias("tie"),
            *([F.struct(*(F.col(c) for c in docs.columns)).alias("row")] if carry else []),
        ).withColumn("stratum", F.coalesce(F.floor(F.log("key") * strata).cast("long"), F.lit((1 << 63) - 1))),
        "mix-sized",
    )
    sums = materialise(sized.groupBy("source", "stratum").agg(F.sum("size").alias("sum")), "mix-sums")
    planned = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, most)
    planned = planned.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    planned = planned.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    planned = materialise(planned.withColumnRenamed("source", "of"), "mix-planned")
    up_to = Window.partitionBy("source").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("before", F.coalesce(F.sum("sum").over(up_to), F.lit(0)))
        .join(planned, F.col("source").eqNullSafe(F.col("of")))
        .where("before < rest AND rest <= before + sum")
        .select("of", F.col("stratum").alias("end_stratum"), F.col("before"))
    )
    planned = materialise(planned.join(ends.withColumnRenamed("of", "end_of"), F.col("of").eqNullSafe(F.col("end_of")), "left").drop("end_of"), "mix-ends")
    few = planned.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = sized.join(F.broadcast(planned) if few else planned, F.col("source").eqNullSafe(F.col("of")))
    at_end = F.col("stratum") == F.col("end_stratum")
    within = Window.partitionBy("source").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.col("id").alias(id_col), "size", "source_size", "target", *(["row"] if carry else [])]
    whole = joined.where(F.coalesce(~at_end, F.lit(True))).select(
        *columns, (F.col("epochs") * F.col("size") + F.when(F.col("stratum") < F.col("end_stratum"), F.col("size")).otherwise(0)).alias("taken")
    )
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    cut = joined.where(at_end).select(
        *columns, (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long").alias("taken")
    )
    return whole.union(cut)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents as the mix takes them: whole copies, then first words.

    A document taken n times is n rows; a last partial copy has the text up to
    its last taken word, and ``n_chars``, where there is such a column, its new
    length.  Documents of no words are in no mix and go.
    """
    taken = mix(docs, id_col, text_col, carry=True, **options).where("taken > 0").select("row", "size", "taken")
    copies = taken.withColumn("words_left", F.explode(F.sequence(F.col("taken"), F.lit(1), -F.col("size"))))
    text = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), 1, F.col("words_left").cast("int")), "")
    copies = copies.withColumn("words", F.when(F.col("words_left") < F.col("size"), cut).otherwise(text))
    own = {text_col: F.col("words"), "n_chars": F.length("words").cast("long")}
    return copies.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
