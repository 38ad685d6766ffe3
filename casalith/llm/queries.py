"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_text, merkle, mixing, pii, secrets, sharding, simhash, toxicity
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_format_chat": lambda spark, d: chat.op1(table(spark, d, "conversations")),
        "op2_mix_sources": lambda spark, d: mixing.op2(table(spark, d, "documents")),
        "op3_extract_html": lambda spark, d: html_text.op3(table(spark, d, "pages")),
        "op4_decontaminate": lambda spark, d: decontaminate.op4(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op5_near_duplicates": lambda spark, d: simhash.op5(table(spark, d, "documents")),
        "op6_toxicity": lambda spark, d: toxicity.op6(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_find_pii": lambda spark, d: pii.op7(table(spark, d, "documents")),
        "op8_shard": lambda spark, d: sharding.op8(table(spark, d, "documents")),
        "op9_fingerprint": lambda spark, d: merkle.op9(table(spark, d, "documents")),
        "op10_scan_secrets": lambda spark, d: secrets.op10(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_format_chat": chat.OP1_SQL, "op4_decontaminate": decontaminate.OP4_SQL}
