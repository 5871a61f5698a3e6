"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglane.llm import bpe, dac, decontam, html, jaccard, langid, mixing, mlm, neardup, quality, rules, spelling, whitening
from loglane.llm.shared import crc_mod, store, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op4_jaccard_join", jaccard.SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op3_pareto_mix", mixing.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(table(spark, folder, "documents"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learn = docs.filter(crc_mod("doc_id", 4) != 2)
    rows = langid.identify(docs.select("doc_id", "text"), learn, tokenizer_file("piece_bpe_32k.model"))
    return rows.select("row.doc_id", (crc_mod("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op1_quality_classifier")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    # The result needs no text, so the statistics are made once and read again.
    rows = quality.with_statistics(table(spark, folder, "documents").select("doc_id", "text"))
    rows = store(rows.select("row.doc_id", "stats"), "stats")
    learn = rows.join(labels.filter(crc_mod("doc_id", 5) != 0), "doc_id").select("stats", "label")
    out = quality.scored(rows, quality.fit(learn)).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    rows = bpe.encode_packed(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe.digests(rows, ranks).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op5_token_codes")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return dac.checked(dac.written(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json")))


@query("op6_cross_polytope", neardup.SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "embeddings"))


@query("op7_risk_rules", rules.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = rules.judge(table(spark, folder, "documents").select("doc_id", "text"), labels)
    return rows.select("row.doc_id", *rules.COLUMNS, "base_failed", "kept")


@query("op2_html_density")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = html.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return rows.select("row.page_id", "row.url", "text", "n_chars")


@query("op8_masked_lm")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = mlm.pseudo_likelihood(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_tokens", "log_likelihood", "score")


@query("op11_suffix_automaton", decontam.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    n_items = F.size("items").cast("long").alias("n_items")
    return rows.select("row.doc_id", "n_words", "n_hit", n_items, digest, (F.col("n_hit") > 0).alias("contaminated"))


@query("op12_spelling_variants", spelling.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(spelling.counted(table(spark, folder, "documents"), drop_every=199))


@query("op13_qd_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    rows = rows.select("row.vec_id", F.posexplode("whitened").alias("place", "whitened"), "n", "deviation", "explained", "identity_error")
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
        F.col("explained")[F.col("place")].alias("explained"), "identity_error",
    )
