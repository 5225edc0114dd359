"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, decides, and hands on the columns of
``documents``; the last returns token ids.  Rows with null or empty texts have no
language and leave at the first stage.  Texts are worked on whole, however long.

Rows are told apart by ``doc_id`` and text: of rows that repeat both one stays at the
second stage, a null ``doc_id`` is an id like another, and rows that share an id but no
text are judged each by its text.  An empty table gives an empty table, and columns
besides those of ``documents`` go along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import bpe, decontaminate, langid, secrets, simhash
from stratalens.runtime import materialize, spread, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return langid.accept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials in texts become a mark."""
    return secrets.redact_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and of decoded bytes."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode_tokens),
]

#: Rank-order profiles and SimHash components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
