"""From raw documents to token ids: the stages of a training-text pipeline, each written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglane.llm import bpe, jaccard, langid, mixing, quality
from loglane.llm.shared import crc_mod, store, table

# Share of the text's probability that the predicted language must have.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; learned from the documents' own ``lang``."""
    learn = docs.filter(crc_mod("doc_id", 4) != 2)
    rows = langid.identify(docs, learn, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; learned from the table ``labels``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = quality.classify(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    return rows.filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_sources(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of each row."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return rows.select("row.*", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_each),
    ("mix_sources", mix),
    ("byte_bpe", token_ids),
]

# Learned models and byte-pair encoding are beyond SQL; the tests follow the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
