"""Language identification by prediction by partial matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.textbytes import bounded_batches, utf8
from gneiss.storage import materialise

#: Symbols in a gram: a context of ORDER - 1 bytes and the byte it predicts.
ORDER = 4
UNKNOWN = "und"
#: Above this many languages the trees would not fit the driver; training raises.
MOST_LANGUAGES = 1_000
#: Cells of a table of the trees (grams times languages) above which training raises; a table of
#: grams times symbols beyond it is searched instead of indexed.
MOST_CELLS = 1 << 26
#: Counts of a gram in a language that the driver takes at most; beyond that training raises.
MOST_GRAMS = 1 << 24
#: Counts that a task holds before it hands them on.
FLUSH = 1 << 20
#: Bytes of whole texts whose grams are counted at once, and cells (bytes times languages) scored at once.
PART = 1 << 18
#: Code lengths are kept in steps of 1/65536 bit, so their sums are the same in any order.
STEP = 1 << 16


def _grams(batches):
    """Counts of all grams of 1 to ORDER bytes in each language, summed up to FLUSH of the longest at a time."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def summed(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        order = np.argsort(keys, kind="stable")
        return _run_sums(keys[order], counts[order])

    def flushed():
        for lang in sorted(held):
            keys, counts = summed(lang)
            for n in range(1, ORDER + 1):
                grams = keys >> 8 * (ORDER - n)
                whole = (grams & 255) > 0  # others reach over the text's end
                grams, c = _run_sums(grams[whole], counts[whole])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(pa.array(np.zeros(len(grams), np.int32))), pa.array(np.full(len(grams), n, np.int32)), pa.array(grams.astype(np.int64)), pa.array(c)], ["lang", "n", "gram", "c"]
                )
        held.clear()

    size = 0
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            data, offsets = utf8(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))
            data = fold(data)
            for at in range(0, len(data), PART):  # every gram begins in one part
                to = min(at + PART + ORDER - 1, len(data))
                keys, counts = np.unique(_padded_keys(data[at:to], offsets[(offsets > at) & (offsets <= to)] - at)[:PART], return_counts=True)
                held.setdefault(lang, []).append((keys, counts))
                size += len(keys)
        if size > FLUSH:
            held = {lang: [summed(lang)] for lang in held}
            size = sum(len(keys) for ((keys, _),) in held.values())
            if size > FLUSH // 2:
                yield from flushed()
                size = 0
    yield from flushed()


def _run_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted keys and the sums of their counts."""
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + 1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def fold(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case; digits, controls and blanks as a space."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    table[:0x41] = 0x20
    table[[0x27, 0x2D]] = [0x27, 0x2D]
    return table[data]


def _padded_keys(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ORDER bytes from each place on as an integer; zeros, which folded text
    has none of, stand for what lies behind the row's end."""
    padded = np.concatenate([data, np.zeros(ORDER - 1, np.uint8)])
    key = np.zeros(len(data), np.uint32)
    for k in range(ORDER):
        key = (key << np.uint32(8)) | padded[k : k + len(data)]
    for k in range(1, ORDER):
        at = ends - k
        key[at[at >= 0]] &= np.uint32((1 << 32) - (1 << 8 * (ORDER - k)))
    return key


class ContextTrees:
    """The frozen trees of all languages as arrays for lookups by position.

    ``grams[n]`` are the known grams of n bytes over all languages, sorted;
    ``cost[n][g]`` is, for each language, the code length in bits of the last
    byte of gram g behind the others: with escape method C a context seen n
    times with d different bytes gives count / (n + d) to each of these and
    d / (n + d) to the escape to the next shorter context.  ``escape[n][g]`` is
    the escape's length behind context g, 0 where a language has not seen it.
    """

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.grams, self.cost, self.escape = langs, {}, {}, {}
        self.limits = np.full(len(langs), np.inf)
        n_langs = len(langs)
        if max(len(grams) for grams, _ in counts.values()) * n_langs > MOST_CELLS:
            raise ValueError(f"trees of more than {MOST_CELLS:,} cells; train on fewer languages")
        lower = np.full((1, n_langs), 8.0)  # order -1: every byte alike
        for n in range(1, ORDER + 1):
            grams, c = counts[n]  # c: (grams, languages)
            context = grams >> 8
            known = self.grams.get(n - 1, np.zeros(1, np.int64))
            at = np.searchsorted(known, context) if n > 1 else np.zeros(len(grams), np.int64)
            total, kinds = np.zeros((len(known), n_langs)), np.zeros((len(known), n_langs))
            np.add.at(total, at, c)
            np.add.at(kinds, at, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escape[n - 1] = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0).astype(np.float32)
                self.escape[n - 1] = np.round(self.escape[n - 1] * STEP) / STEP
                own = np.round(np.log2((total + kinds)[at] / c) * STEP) / STEP
            suffix = lower[np.searchsorted(self.grams[n - 1], grams & ((1 << 8 * (n - 1)) - 1))] if n > 1 else np.broadcast_to(lower, c.shape)
            self.grams[n], self.cost[n] = grams, np.where(c > 0, own, self.escape[n - 1][at] + suffix).astype(np.float32)
            lower = self.cost[n]
        self.children = {n: self._children(n) for n in range(2, ORDER + 1)}
        first = np.full(256, -1, np.int32)
        first[self.grams[1]] = np.arange(len(self.grams[1]), dtype=np.int32)
        self.first = first

    def _children(self, n: int) -> tuple[np.ndarray, bool]:
        """Where gram n is by index of gram n - 1 times symbols plus the last byte's own index:
        a table (-1: unknown), or, where that would be too large, the sorted places themselves."""
        width = len(self.grams[1])
        places = np.searchsorted(self.grams[n - 1], self.grams[n] >> 8).astype(np.int64) * width + np.searchsorted(self.grams[1], self.grams[n] & 255)
        if len(self.grams[n - 1]) * width > MOST_CELLS:
            return places, False
        table = np.full(len(self.grams[n - 1]) * width, -1, np.int32)
        table[places] = np.arange(len(places), dtype=np.int32)
        return table, True

    def _child(self, n: int, place: np.ndarray) -> np.ndarray:
        children, is_table = self.children[n]
        if is_table:
            return children[place]
        at = np.minimum(np.searchsorted(children, place), len(children) - 1)
        return np.where(children[at] == place, at, -1)

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each byte under each language; no context reaches over a row's start."""
        def previous(nodes: np.ndarray) -> np.ndarray:
            before = np.concatenate([[-1], nodes[:-1]])
            before[starts] = -1
            return before

        symbol = self.first[data]
        unknown = symbol < 0
        width = len(self.grams[1])
        node = {1: symbol}
        for n in range(2, ORDER + 1):
            before = previous(node[n - 1])
            found = np.full(len(data), -1, np.int32)
            both = (before >= 0) & ~unknown
            found[both] = self._child(n, before[both].astype(np.int64) * width + symbol[both])
            node[n] = found
        out = np.zeros((len(data), len(self.langs)), np.float32)
        open_ = np.ones(len(data), bool)
        for n in range(ORDER, 0, -1):
            hit = open_ & (node[n] >= 0)
            out[hit] += self.cost[n][node[n][hit]]
            open_ &= ~hit
            if n > 1:  # the context is known, the byte behind it is not: escape
                before = previous(node[n - 1])
                miss = open_ & (before >= 0)
                out[miss] += self.escape[n - 1][before[miss]]
        out[open_] += 8.0 + self.escape[0][0]
        return out


def training_rows(texts: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, text)`` of every row with a language and a text."""
    rows = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("lang") != UNKNOWN)


def train(spark: SparkSession, texts: DataFrame, text_col: str, lang_col: str, id_col: str | None = None) -> ContextTrees | None:
    """Trees from the whole texts of all rows that have a language, counted in parts of PART bytes.

    Only sums leave the tasks: one a language and gram of up to ORDER bytes.  Ids play no part.
    """
    counted = training_rows(texts, text_col, lang_col).mapInArrow(_grams, "lang string, n int, gram long, c long")
    counted = materialise(counted.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "language-grams")
    langs = sorted(r["lang"] for r in counted.where("n = 1").select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES:,} languages in {lang_col}")
    if not langs:
        return None
    if counted.count() > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS:,} grams by language in {text_col}")
    table = counted.toArrow().to_pandas()
    column = table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    counts = {}
    for n in range(1, ORDER + 1):
        part = table["n"].to_numpy() == n
        grams, at = np.unique(table["gram"].to_numpy()[part], return_inverse=True)
        c = np.zeros((len(grams), len(langs)))
        np.add.at(c, (at, column[part]), table["c"].to_numpy()[part])
        counts[n] = grams, c
    return ContextTrees(langs, counts)


#: A text is in a language up to the median of its training texts' bits a byte and this many times
#: the way from there to their 99th percentile, or LEAST_SPREAD bits where that is shorter ...
SPREAD, LEAST_SPREAD = 12, 2.0
#: ... and this many bits for the whole text, so one strange character rejects no short one.
ALLOWANCE = 64
#: Bits a byte are counted in so many steps a bit, which bounds the different ones whatever the rows.
SPREAD_STEP = 1 << 12


def code_length_limits(spark: SparkSession, trees: ContextTrees, training: DataFrame) -> np.ndarray:
    """For each language the bits a byte up to which a text is in it, from the
    spread over all training texts ``(lang, text)`` that its own tree codes best;
    8, the length of plain bytes, where there is none.  Percentiles are those of
    the counts of each step of bits a byte."""
    rows = training.where(F.col("text").rlike("\\p{L}")).select(F.struct("lang").alias("row"), "text", F.lit(True).alias("text_has_letter"))
    scored = rows.mapInArrow(_identifier(spark.sparkContext.broadcast(trees)), "row struct<lang: string>, letter boolean, pred string, score double, bits_per_byte double, within boolean")
    steps = scored.where("row.lang = pred").groupBy("pred", F.ceil(F.col("bits_per_byte") * SPREAD_STEP).alias("step")).count()
    spread = steps.groupBy("pred").agg(F.percentile("step", [0.5, 0.99], F.col("count")).alias("q")).select("pred", F.transform("q", lambda x: x / SPREAD_STEP).alias("q")).collect()
    found = {r["pred"]: r["q"][0] + max(SPREAD * (r["q"][1] - r["q"][0]), LEAST_SPREAD) for r in spread}
    return np.array([found.get(x, 8.0) for x in trees.langs])


def _identifier(shared, text_at: int = -1):
    """Scores the column ``text``, or the field of ``row`` at ``text_at``."""

    def identify(batches):
        trees = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("row").field(text_at) if text_at >= 0 else batch.column("text"))
            data = fold(data)
            part = max(PART // len(trees.langs), 1 << 12)
            bits = np.zeros((len(offsets) - 1, len(trees.langs)))
            at = 0
            while at < len(data):  # every byte is scored once
                to = min(at + part, len(data))
                lead = min(at, ORDER - 1)
                begins = offsets[np.searchsorted(offsets, at - lead) : np.searchsorted(offsets, to)] - (at - lead)
                costs = trees.lengths(data[at - lead : to], begins)[lead:]
                first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to, "left")
                edges = np.clip(offsets[first : last + 1], at, to) - at
                some = np.flatnonzero(np.diff(edges) > 0)
                bits[first + some] += np.add.reduceat(costs, edges[some], axis=0, dtype=np.float64)
                at = to
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, np.int64)
            ahead = bits - bits.min(axis=1, keepdims=True) if len(bits) else bits
            score = 1 / np.exp2(-np.minimum(ahead, 1000)).sum(axis=1)
            per_byte = bits.min(axis=1, initial=np.inf) / np.maximum(np.diff(offsets), 1)
            within = bits.min(axis=1, initial=np.inf) <= np.diff(offsets) * trees.limits[best] + ALLOWANCE
            pred = np.array(trees.langs, object)[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text_has_letter"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64()), pa.array(within, pa.bool_())],
                ["row", "letter", "pred", "score", "bits_per_byte", "within"],
            )

    return identify


def identify_rows(docs: DataFrame, training: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, reject: bool = False) -> DataFrame:
    """``(row, lang_pred, score, bits_per_byte)`` of every row of ``docs``; ``row`` is a
    struct of the columns to carry, by default all, so clashing names do no harm.

    Each language has a byte context tree of up to ORDER - 1 bytes of context,
    trained on the whole texts of all rows of ``training`` and then frozen; a whole text's
    exact code length under each tree is summed, and the shortest names the
    language (ties: the first by code point).  ``score`` is that language's
    share of the probability.  Ids and sources are never looked at.

    A null text or one without a letter is ``und`` with score 0; so is every
    text when the training rows have no language, and, with ``reject``, a text
    whose code length is above its language's limit: one in a language that was
    not learned, or in none (``code_length_limits``).  Rows that repeat are scored
    each.  The trees (a few MB; training raises above MOST_GRAMS counts or MOST_CELLS
    cells) are broadcast; there is no shuffle of the texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    carry = carry or docs.columns
    letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    text_at = carry.index(text_col) if text_col in carry else -1
    rows = docs.select(F.struct(*(F.col(c) for c in carry)).alias("row"), *([] if text_at >= 0 else [F.col(text_col).alias("text")]), letter.alias("text_has_letter"))
    trees = train(spark, training, text_col, lang_col)
    if trees is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    if reject:
        trees.limits = code_length_limits(spark, trees, training_rows(training, text_col, lang_col))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_identifier(spark.sparkContext.broadcast(trees), text_at), f"row {kind}, letter boolean, pred string, score double, bits_per_byte double, within boolean")
    named = F.col("letter") & F.col("within")
    return out.select(
        "row",
        F.when(named, F.col("pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(named, F.col("score")).otherwise(0.0).alias("score"),
        "bits_per_byte",
    )


def fold_of(id_col: str, folds: int) -> Column:
    """The fold of a row: crc32 of its id's text, modulo the number of folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """``(id_col, held_out, lang_pred, score)``: fold 0 is held out of the training."""
    scored = identify_rows(docs, docs.where(fold_of(id_col, folds) != 0), lang_col=lang_col, carry=[id_col]).select("row.*", "lang_pred", "score")
    return scored.select(id_col, (fold_of(id_col, folds) == 0).alias("held_out"), "lang_pred", "score")
