"""The training-data queries of the driver contract and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import bpe, chat, decontaminate, langid, lines, pii, secrets, simhash, suffix, warc
from stratalens.runtime import spread, table


def _on(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spread(table(spark, sf_dir, name)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": lambda spark, sf_dir: decontaminate.op1(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")),
        "op2_language_id": _on("documents", langid.op2),
        "op3_secret_scan": _on("documents", secrets.op3),
        "op4_suffix_dedup": _on("documents", suffix.op4),
        "op5_byte_bpe": _on("documents", bpe.op5),
        "op6_warc": _on("pages", warc.op6),
        "op7_chat_format": _on("conversations", chat.op7),
        "op8_pii": _on("documents", pii.op8),
        "op9_line_quality": _on("documents", lines.op9),
        "op10_simhash": _on("documents", simhash.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL, "op6_warc": warc.SQL, "op9_line_quality": lines.SQL}
