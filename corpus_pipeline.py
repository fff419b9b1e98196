"""A training corpus from documents: five filters and encodings of keylake.llm in a row.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's
result to the shared folder and reads it again for the next one, after which it is removed; the last stage's input stays.

Rows with null text pass every filter and encode to no tokens. Rows with null doc_id count like others. Repeated rows with
words: one stays after the second stage. Extra columns, of any name, are carried to the last stage. Texts of any length are
worked on whole. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keylake.llm import byte_bpe, decontaminate, jaccard, secret_scan, toxicity
from keylake.session import drop, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from all labelled documents."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near duplicates."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; a row goes by its own text, with or without an id."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, and whether the ids decode to its text."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, checked=True)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_duplicates), ("decontamination", drop_contaminated), ("secret_scan", mask_secrets), ("byte_bpe", tokenize)]

#: A trained classifier and merges by rank are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

