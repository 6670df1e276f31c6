"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.textbytes import bounded_batches
from gneiss.storage import materialise

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST, TIMES = 3, 8, 3
#: Smallest word hashes that name a family; one alone is shared by unrelated texts with one common word.
MINIMA = 3
#: Different features that a task holds before it hands their counts on.
FLUSH = 200_000


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def beginnings(words: set[str]) -> Counter:
    """How many different words have each beginning; a whole word ends in ``$``.

    Inflected insults share a beginning and differ behind it, so two different
    words with one beginning say more than one word twice.
    """
    out = Counter(w[:k] for k in range(SHORTEST, LONGEST + 1) for w in words if len(w) >= k)
    out.update(w + "$" for w in words)
    return out


def features_of(words: set[str]) -> list[str]:
    """``beginning#n`` for each n up to TIMES that a beginning's words reach."""
    return [f"{b}#{n}" for b, c in beginnings(words).items() for n in range(1, min(c, TIMES) + 1)]


def _family(words: set[str]) -> int:
    """Equal for copies, and mostly equal for near copies: the words' MINIMA smallest hashes together."""
    least = heapq.nsmallest(MINIMA, (xxhash.xxh3_64_intdigest(w) for w in words))
    return xxhash.xxh3_64_intdigest(",".join(map(str, least))) >> 1


def _family_rows(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_family(words_of(t.as_py())) for t in batch.column("text")], pa.int64())], ["family"])


def _votes(batches):
    """``(feature, family)`` of every text, each pair once a part of FLUSH of them."""

    def flushed():
        features, families = zip(*votes, strict=True) if votes else ((), ())
        votes.clear()
        return pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array(families, pa.int64())], ["feature", "family"])

    votes: set[tuple[str, int]] = set()
    for batch in batches:
        for text in batch.column("text"):
            words = words_of(text.as_py())
            family = _family(words)
            votes.update((f, family) for f in features_of(words))
            if len(votes) >= FLUSH:
                yield flushed()
    yield flushed()


def _feature_counts(batches):
    """``(feature, up, down)``: in how many rows of the mixture a feature is (down), summed up to FLUSH features at a time."""

    def flushed():
        features = list(down.keys())
        counts = [down[f] for f in features]
        down.clear()
        return pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array([0] * len(features), pa.int64()), pa.array(counts, pa.int64())], ["feature", "up", "down"])

    down = Counter()
    for batch in batches:
        for text in batch.column("text"):
            down.update(features_of(words_of(text.as_py())))
            if len(down) >= FLUSH:
                yield flushed()
    yield flushed()


def support(positives: DataFrame, mixture: DataFrame) -> tuple[DataFrame, int]:
    """``(feature, up, down)`` and the number of voters, from two tables of ``text``.

    ``up`` counts the families of positives in which any text has the feature;
    ``down`` counts the rows of the mixture that have it.
    """
    votes = positives.mapInArrow(_votes, "feature string, family long").distinct().select("feature", F.lit(1).cast("long").alias("up"), F.lit(0).cast("long").alias("down"))
    counted = votes.union(mixture.mapInArrow(_feature_counts, "feature string, up long, down long"))
    voters = positives.mapInArrow(_family_rows, "family long").distinct().count()
    return counted.groupBy("feature").agg(F.sum("up").alias("up"), F.sum("down").alias("down")), voters


class WordModel:
    """A linear classifier on word beginnings and the number of words."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias
        self.index: dict[str, list[int]] = {}
        for i, feature in enumerate(vocabulary):
            beginning, _, n = feature.rpartition("#")
            self.index.setdefault(beginning, [-1] * TIMES)[int(n) - 1] = i
        self.lead = {b[:SHORTEST] for b in self.index if len(b.rstrip("$")) >= SHORTEST}
        self.short = {b for b in self.index if len(b.rstrip("$")) < SHORTEST}

    def present(self, words: set[str]) -> list[int]:
        """The vocabulary's features that a text of these words has."""
        near = {w for w in words if w[:SHORTEST] in self.lead or w + "$" in self.short}
        return [i for b, c in beginnings(near).items() if b in self.index for i in self.index[b][:c] if i >= 0]

    def margin(self, text: str | None) -> float:
        words = words_of(text)
        return self.bias + self.weights[-1] * np.log1p(len(words)) / 10 + sum(self.weights[i] for i in self.present(words))


def fit_non_negative(positive: np.ndarray, mixture: np.ndarray, prior: float, warm: int = 200, steps: int = 600, rate: float = 0.05, sparse: float = 3e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias minimising the non-negative PU risk.

    The risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]): the
    negative part is what unlabelled text costs less the share that its hidden
    positives must cost.  Where that falls below 0 the model has begun to fit
    the unlabelled positives as negatives, and the step goes up that part
    instead of down the whole.  The first ``warm`` steps use the logistic loss,
    the others the sigmoid loss, which hidden positives far on their side do
    not move.  Mini-batches with Adam; a proximal L1 step leaves no weight to
    features that only accompany stronger ones.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    positive, mixture = positive.astype(np.float32), mixture.astype(np.float32)
    w, m, v = (np.zeros(positive.shape[1] + 1, np.float32) for _ in range(3))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        xp = positive[rng.integers(0, len(positive), min(1024, len(positive)))]
        xu = mixture[rng.integers(0, len(mixture), min(4096, len(mixture)))]
        gp, gu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        sp, su = sigmoid(gp), sigmoid(gu)
        if step <= warm:
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            du, dn, dp = su, sp, sp - 1
        else:
            negative = su.mean() - prior * sp.mean()
            du, dn, dp = su * (1 - su), sp * (1 - sp), -sp * (1 - sp)
        # Derivatives of the unlabelled term, of the hidden positives' and of the positives' own.
        du, dn, dp = du / len(gu), prior * dn / len(gp), prior * dp / len(gp)
        if negative >= 0:
            grad = np.append(xu.T @ du + xp.T @ (dp - dn), du.sum() + (dp - dn).sum())
        else:
            grad = -np.append(xu.T @ du - xp.T @ dn, du.sum() - dn.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= scale * m / (1 - 0.9**step)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - scale[:-1] * sparse, 0)
    return w[:-1].astype(np.float64), float(w[-1])


def _matrix_rows(shared):
    def rows(batches):
        model = shared.value
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("toxic"), pa.array(map(len, found), pa.int64()), pa.array([sorted(model.present(w)) for w in found], pa.list_(pa.int32()))],
                ["place", "toxic", "n", "features"],
            )

    return rows


def _closed(ranked: list[tuple[str, int, int]], most: int) -> list[str]:
    """The first ``most`` features, without beginnings that a longer one with the same counts extends."""
    longer = {(up, down, f.rpartition("#")[2], f.rpartition("#")[0].rstrip("$")[:-1]) for f, up, down in ranked}
    return [f for f, up, down in ranked if (up, down, f.rpartition("#")[2], f.rpartition("#")[0]) not in longer][:most]


def train(spark: SparkSession, texts: DataFrame, labels: DataFrame, most_positive: int = 4_000, most_mixture: int = 16_000, vocabulary: int = 1_024, least_support: int = 5) -> WordModel | None:
    """A model from ``(id, text)`` and ``(id, label)``: label 1 confirmed toxic, 0 or none unlabelled.

    The classifier sees a bounded sample: at most ``most_positive`` positives and
    ``most_mixture`` of all documents (the unlabelled mixture, whatever their
    labels), the first by a hash of the id and the text.  A document is an id
    with a text, repeated rows are one; a positive id counts once, with one of
    its texts, and the class prior counts ids.  Features are word beginnings met in
    at least ``least_support`` families of positives (near copies share a
    family, so a text copied a thousand times is one vote, and every text of a
    family is counted); the ``vocabulary``
    of them that most exceed their share in the mixture, by the lower end of
    the log ratio, enter.  These bounds bound what the driver holds.  The class
    prior is the labelled documents' share of positives where there are labels
    0, else 0.05.

    Labels meet ids without texts, and samples are chosen among hashes; only the
    chosen hashes, a bounded number, are broadcast to the texts, which are never
    shuffled whole.
    """
    named = labels.where("id IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    documents = materialise(texts.select("id", F.xxhash64("id", "text").alias("place")).distinct(), "toxic-documents")
    known = materialise(documents.where("id IS NOT NULL").groupBy("id").agg(F.min("place").alias("place")).join(named, "id").select("id", "place", "label"), "toxic-known")
    p, zero = known.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    u = documents.count()
    if not p or p == u:
        return None
    prior = min(max(p / (p + zero) if zero else 0.05, 1e-3), 0.5)

    def first(rows: DataFrame, count: int, most: int, toxic: bool) -> DataFrame:
        """The ``most`` first places of ``count``; a hash share somewhat above them is all that is put in order."""
        unit = F.col("place").cast("double") / 2.0**64 + 0.5
        share = (most + 6 * most**0.5) / count
        near = rows.where(unit < share) if share < 1 else rows
        return near.select("place").distinct().orderBy("place").limit(most).select("place", F.lit(toxic).alias("toxic"))

    chosen = first(known.where("label = 1"), p, most_positive, True).union(first(documents, u, most_mixture, False))
    chosen = chosen.groupBy(F.col("place").alias("chosen")).agg(F.collect_set("toxic").alias("kinds"))
    marked = texts.select(F.xxhash64("id", "text").alias("place"), "text").join(F.broadcast(chosen), F.col("place") == F.col("chosen"))
    sample = marked.select("place", "text", F.explode("kinds").alias("toxic")).dropDuplicates(["place", "toxic"])
    sample = materialise(sample.repartition(4 * spark.sparkContext.defaultParallelism), "toxic-sample")
    n_p, n_u = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not n_p or not n_u:
        return None
    counted, voters = support(sample.where("toxic").select("text"), sample.where("NOT toxic").select("text"))
    counted = counted.where(F.col("up") >= least_support)
    ratio = F.log(F.col("up") / voters) - F.log((F.col("down") + 0.5) / n_u)
    # Two standard errors of the log ratio are taken off, so chance and few votes do not carry a feature.
    low = ratio - 2 * F.sqrt(1 / F.col("up") + 1 / (F.col("down") + 0.5 + F.col("up")))
    ranked = counted.withColumn("low", low).where("low > 0").orderBy((F.col("low") * F.col("up")).desc(), "feature").limit(8 * vocabulary)
    chosen = _closed([(r["feature"], r["up"], r["down"]) for r in ranked.collect()], vocabulary)
    if not chosen:
        return None
    shared = spark.sparkContext.broadcast(WordModel(chosen, np.zeros(len(chosen) + 1), 0.0))
    # No document is folded here: the prior and the mixture must speak of the same ones.
    # Their rows are put in an order of their own, so the same documents give the same model however they are dealt out.
    table = sample.mapInArrow(_matrix_rows(shared), "place long, toxic boolean, n long, features array<int>").toArrow().sort_by([("place", "ascending"), ("toxic", "ascending")])
    x = np.zeros((table.num_rows, len(chosen) + 1), np.float32)
    for row, features in enumerate(table.column("features").to_pylist()):
        x[row, features] = 1
    x[:, -1] = np.log1p(table.column("n").to_numpy()) / 10
    toxic = table.column("toxic").to_numpy()
    weights, bias = fit_non_negative(x[toxic], x[~toxic], prior)
    return WordModel(chosen, weights, bias)


def _scorer(shared, text_at: int):
    """Scores the column ``text``, or the field of ``row`` at ``text_at``."""

    def score(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("row").field(text_at) if text_at >= 0 else batch.column("text")
            margins = np.array([model.margin(t.as_py()) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1 / (1 + np.exp(-np.clip(margins, -50, 50))))], ["row", "score"])

    return score


def scored_rows(docs: DataFrame, texts: DataFrame, labels: DataFrame, text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """``(row, score)`` of every row of ``docs``, from its whole text alone; ``row``
    is a struct of the columns to carry, by default all, so clashing names do no harm.

    ``texts`` (id, text) and ``labels`` (id, label; 1 toxic, 0 or none unlabelled)
    are what is learned from.  A word is a run of letters in lower case; a
    text's margin is the sum of the weights of its words' beginnings, each
    counted up to TIMES different words, and of the logarithm of its number of
    different words.  Null and empty texts have the score of no words; without
    a positive or an unlabelled document every score is 0.  Rows may repeat; they
    are one document to what is learned.
    The model (about a thousand beginnings) is broadcast; there is no shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    carry = carry or docs.columns
    text_at = carry.index(text_col) if text_col in carry else -1
    rows = docs.select(F.struct(*(F.col(c) for c in carry)).alias("row"), *([] if text_at >= 0 else [F.col(text_col).alias("text")]))
    model = train(spark, texts, labels, **options)
    if model is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model), text_at), f"row {kind}, score double")


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """Whether a row is held out: crc32 of its id's text, modulo the folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def held_out_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, carry: list[str] | None = None, **options
) -> DataFrame:
    """``(row, held_out, score, predicted)`` of every row; fold 1 of 3 takes no part in the training.

    ``row`` has the columns of ``carry``, by default the id alone.
    """
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    scored = scored_rows(docs, texts, known, text_col, carry or [id_col], **options)
    return scored.select("row", held_out(f"row.{id_col}").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
