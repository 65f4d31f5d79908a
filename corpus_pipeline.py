"""Cleans a corpus in stages; each writes its documents as Parquet, and the next reads them.

Language ID drops texts whose language can't be told, the Jaccard join keeps one document of each group of near
copies, decontamination drops documents that hold a benchmark item, the secret scan drops those that hold a
live-looking credential of few owners, and mixing repeats documents to their source's target rate in a global order.

Null texts go with the first stage. Rows with a null id are judged like others, but as no near copy of any row; rows of
one id go together where one of them holds an item or a credential. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language_id, partenum, poisson_mix, secret_scan
from tidemark.llm._common import stage


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity 0.8 or more; the least doc_id of each group stays."""
    return partenum.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.without_live_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with copies, replica and shuffle_key, in training order."""
    return poisson_mix.replicate(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", tell_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", drop_secrets),
    ("mixing", mix),
]
#: SQL can express neither the language model nor the edit distances; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
