"""The registered queries of this subpackage: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, language, mixing, near_dedup, privacy, quality, secrets, sql, tool_calls, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": lambda s, d: decontaminate.op1(table(s, d, "documents"), table(s, d, "benchmark")),
    "op2_embedding_dedup": lambda s, d: embedding_dedup.op2(table(s, d, "embeddings")),
    "op3_tool_calls": lambda s, d: tool_calls.op3_whole(table(s, d, "conversations")),
    "op4_secrets": lambda s, d: secrets.op4(table(s, d, "documents")),
    "op5_mix": lambda s, d: mixing.op5(table(s, d, "documents")),
    "op6_language": lambda s, d: language.op6(table(s, d, "documents")),
    "op7_quality": lambda s, d: quality.op7(table(s, d, "documents"), table(s, d, "labels")),
    "op8_privacy": lambda s, d: privacy.op8(table(s, d, "documents")),
    "op9_near_dedup": lambda s, d: near_dedup.op9(table(s, d, "documents")),
    "op10_warc": lambda s, d: warc.op10(table(s, d, "pages")),
}
ORACLES: dict[str, str] = sql.ORACLES
