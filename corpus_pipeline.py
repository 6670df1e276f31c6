"""From raw documents to encoded training text, stage by stage.

Each stage takes all documents that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.language import UNKNOWN, fold_of, identify_rows
from gneiss.llm.mixing import mixed_documents
from gneiss.llm.near import drop_near_duplicates
from gneiss.llm.pieces import digests, encode_pieces
from gneiss.llm.toxicity import held_out_toxicity
from gneiss.session import table
from gneiss.storage import materialise, release, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic (0.7 or more) go."""
    scored = held_out_toxicity(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return scored.where("predicted = 0").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: null texts, texts without a letter and
    texts that the best language's tree codes beyond the spread of its own.

    A kept document gets the language that was found.  Each half of the documents is
    judged by trees of the other half, so no text vouches for itself.
    """
    halves = [docs.where(fold_of("doc_id", 2) == k) for k in (0, 1)]
    found = identify_rows(halves[0], halves[1], reject=True).union(identify_rows(halves[1], halves[0], reject=True)).where(F.col("lang_pred") != UNKNOWN)
    return found.select("row.*", "lang_pred").withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: No stage but the mix can be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = written()
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        # What the stage made on its way is not read again once it is written.
        release(before, docs)
    return docs
