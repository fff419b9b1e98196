"""The operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm import byte_bpe, chat, decontaminate, hard_negatives, jaccard, language, quality, secret_scan, token_files, topk, toxicity, url_filter, whitening
from keylake.session import scratch, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out()
    net = language.fit(docs.where(~held))
    return language.identify(docs, net).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(*url_filter.captures_and_list(table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity.score_documents(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations")).drop("seg")


def resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.summaries(spark, path)


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.moved_labels(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid,
        "op2_decontamination": decontamination,
        "op3_secret_scan": secrets,
        "op4_url_filter": urls,
        "op5_toxicity": toxic,
        "op6_byte_bpe": bpe,
        "op7_topk": top_k,
        "op8_chat_format": chats,
        "op9_quality": resampling,
        "op10_jaccard_join": jaccard_join,
        "op11_token_files": tokens,
        "op12_whitening": whitened,
        "op13_hard_negatives": hard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.oracle(), "op4_url_filter": url_filter.oracle(), "op7_topk": topk.oracle(), "op10_jaccard_join": jaccard.oracle(), "op13_hard_negatives": hard_negatives.oracle()}
