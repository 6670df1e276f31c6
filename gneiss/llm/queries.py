"""The numbered queries, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.language import held_out_languages
from gneiss.llm.maintext import extract_main_text
from gneiss.llm.mixing import mix
from gneiss.llm.near import near_duplicates
from gneiss.llm.oracles import ORACLES
from gneiss.llm.pieces import digests, encode_pieces
from gneiss.llm.repeats import remove_repeats
from gneiss.llm.rules import quality_rules
from gneiss.llm.tokens import count_tokens
from gneiss.llm.topk import top_k
from gneiss.llm.toxicity import held_out_toxicity
from gneiss.llm.variants import letter_runs, spelling_variants, vocabulary
from gneiss.llm.warc import through_archives
from gneiss.llm.whitening import whiten
from gneiss.session import table

__all__ = ["ORACLES", "QUERIES"]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through WARC archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = through_archives(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and link count of every document: doc_id, class_id, n_links."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every query vector: query_id, rank, vec_id, score."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document: doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    scored = held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "held_out", "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document: doc_id, n_words, ..., base_failed, kept."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score."""
    return held_out_languages(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word: word, n, n_near, form, form_n, root."""
    return spelling_variants(vocabulary(letter_runs(table(spark, sf_dir, "documents"))))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened vectors, a row a component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes take of every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_mixing": op3_mixing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_main_text": op9_main_text,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}
