"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.storage import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules are ratios; each has cutoffs 1/100, 2/100, ... and rejects what lies above one.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "least(word_chars / greatest(n_words, 1) / 50, 1)",
}
GRID = 100
#: Above this many strata their cutoffs are joined by shuffling, not broadcast.
BROADCAST_STRATA = 10_000


def _repeat_words(windows: Column, width: int) -> Column:
    """Words inside windows that occur more than once: windows sorted by hash
    put equal ones side by side; the union of their intervals is then summed."""
    sorted_ = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    with_before = F.zip_with(sorted_, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), sorted_), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    pairs = F.filter(with_before, lambda p: p["x"]["h"] == p["y"]["h"])
    starts = F.array_sort(F.array_distinct(F.concat(F.transform(pairs, lambda p: p["x"]["i"]), F.transform(pairs, lambda p: p["y"]["i"]))))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-width).alias("last"))
    return F.aggregate(
        starts,
        start,
        lambda acc, i: F.struct((acc["covered"] + F.least(F.lit(width), i - acc["last"])).alias("covered"), i.alias("last")),
        lambda acc: acc["covered"],
    ).cast("long")


def text_measures(docs: DataFrame, text_col: str = "text", width: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Every measure is over the whole text; a null text has no words.  Windows of
    ``width`` words are compared by 64-bit hashes, and only texts in which some
    hash recurs are sorted, so the cost is linear for all others and n log n
    for these, inside one row: there is no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    length = F.length(text)
    out = docs.select(
        *docs.columns,
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    w = F.col("_words")
    window = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
    windows = F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), window)).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_windows", windows)
    recurs = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return out.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(recurs, _repeat_words(F.col("_windows"), width)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


#: Terms of a binomial tail that are summed; what lies below them is bounded and added.
TERMS = 400


def _log_factorial(n: Column) -> Column:
    """ln n!, from Stirling's series above 20, where it is exact to 16 digits."""
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(21)))
    x = F.greatest(n.cast("double"), F.lit(21.0)) + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n <= 20, F.get(small, F.least(n, F.lit(20)).cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k).

    From k down when that is below the mean, else 1 less the sum from k + 1 up:
    on either side terms fall from the first one on, by a factor that only
    shrinks.  The TERMS highest are summed; below the mean the others, at most
    the last one times r / (1 - r) for its factor r, are added.  So the value is
    exact up to rounding for up to TERMS terms, and never too small beyond.
    """
    p, low = F.lit(float(risk)), F.coalesce(k < n * F.lit(float(risk)), F.lit(True))
    n = n.cast("double")
    at = F.greatest(F.lit(0.0), F.least(n, F.when(low, k).otherwise(k + 1).cast("double")))
    first = _log_factorial(n) - _log_factorial(at) - _log_factorial(n - at) + at * F.log(p) + (n - at) * F.log1p(-p)
    factor = lambda i: F.when(low, i * (1 - p) / ((n - i + 1) * p)).otherwise((n - i) * p / ((i + 1) * (1 - p)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(low, F.least(at, F.lit(float(TERMS)))).otherwise(F.least(n - at, F.lit(float(TERMS)))).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda j: F.when(low, at - j).otherwise(at + j))
    places = F.when(steps > 0, places).otherwise(F.array().cast("array<double>"))
    sums = F.aggregate(places, start, lambda acc, i: F.struct((acc["term"] * factor(i)).alias("term"), (acc["sum"] + acc["term"] * factor(i)).alias("sum")))
    last = factor(at - TERMS)
    rest = F.when(low & (at > TERMS), sums["term"] * last / (1 - last)).otherwise(0.0)
    tail = F.exp(first) * (sums["sum"] + rest)
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(F.when(low, F.least(tail, F.lit(1.0))).otherwise(F.greatest(1 - tail, F.lit(0.0))))


def risk_cutoffs(labelled: DataFrame, stratum: str, good: str, risk: float = 0.02, error: float = 0.05, penalty: float = 5.0) -> DataFrame:
    """``(stratum, rule, cutoff)``: the cutoffs that are safe to apply and pay.

    For each stratum and rule, k of the n good labelled documents lie above a
    cutoff.  The cutoff is safe when the exact (Clopper-Pearson) upper bound of
    the false-rejection rate is at most its share of ``risk``, that is, when
    P(Bin(n, share) <= k) is at most the level (never for k at the mean or above); the rules of a stratum share the
    risk equally, so together they keep it.  Cutoffs of one rule are tested from
    the highest down to the first failure, which needs no correction among
    them (k only grows on the way); over strata and rules ``error`` is divided
    by their number (Bonferroni).  All cutoffs that pass are safe at once, and
    of them the one is taken that rejects the most bad documents less
    ``penalty`` times the good ones; ties go to the highest cutoff.  With too
    few labels none is safe, and the rule rejects nothing in that stratum.
    """
    scored = labelled.select(
        F.col(stratum).alias("stratum"),
        (F.col(good) == 1).alias("good"),
        F.explode(F.create_map(*(x for name, rule in RULES.items() for x in (F.lit(name), F.expr(rule))))).alias("rule", "value"),
    )
    # Above cutoff c/GRID lie the values whose bin, ceil(value * GRID) - 1, is at least c.
    binned = scored.groupBy("stratum", "rule", (F.greatest(F.ceil(F.col("value") * GRID), F.lit(0)) - 1).cast("int").alias("bin")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    groups = binned.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("bin", "good", "bad")).alias("bins"))
    groups = groups.withColumn("chains", F.count("*").over(Window.partitionBy()))
    above = lambda kind: F.aggregate(F.filter("bins", lambda b: b["bin"] >= F.col("c")), F.lit(0).cast("long"), lambda acc, b: acc + b[kind])
    levels = groups.select("*", F.explode(F.sequence(F.lit(1), F.lit(GRID - 1))).alias("c"))
    levels = levels.select("stratum", "rule", "c", "n", "chains", above("good").alias("k"), above("bad").alias("hits"))
    safe = levels.where(binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= F.lit(error) / F.col("chains"))
    best = safe.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("hits") - penalty * F.col("k")).alias("gain"), "c")).alias("best"))
    return best.where("best.gain > 0").select("stratum", "rule", (F.col("best.c") / GRID).alias("cutoff"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", risk: float = 0.02, error: float = 0.05
) -> DataFrame:
    """``(id_col, measures, base_failed, kept)`` of every row of ``docs``.

    A document fails the base when it has fewer than 10 words or more than a
    fifth of its words are in repeated five-word windows.  Of the others it is
    kept unless one of ``RULES`` exceeds the cutoff of its stratum; cutoffs are
    set by ``risk_cutoffs`` on the labelled documents that pass the base.

    Texts are measured once, into a table without them; labels join it by id,
    and the cutoffs, one row a stratum and rule, are broadcast after a check of
    their number.  A null stratum is one of its own; null labels and labels
    without a document are ignored; an id with several labels counts once, as
    good if any label says so;
    a null or empty text has no words and fails the base.  Empty labels: every
    document that passes the base is kept.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    measured = text_measures(rows, "text").drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = materialise(measured.withColumn("base_failed", failed), "rules-measured")
    known = labels.select(F.col(id_col).alias("of"), F.col(good_col).alias("good")).where("of IS NOT NULL AND good IS NOT NULL").groupBy("of").agg(F.max("good").alias("good"))
    holdout = measured.where("NOT base_failed").join(known, F.col("id") == F.col("of"))
    cutoffs = risk_cutoffs(holdout, "stratum", "good", risk, error)
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).withColumnRenamed("stratum", "of_stratum")
    wide = materialise(wide.select("of_stratum", *(F.col(r).alias(f"_{r}") for r in RULES)), "rules-cutoffs")
    few = wide.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    judged = measured.join(F.broadcast(wide) if few else wide, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    over = F.lit(False)
    for name, rule in RULES.items():
        over = over | F.coalesce(F.expr(rule) > F.col(f"_{name}"), F.lit(False))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept")
    )
