"""Queries of this subpackage for __spark_entry__.py, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isobar.llm import bpe, chat, media, minhash, mixing, pii, quality, substring, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": minhash.op1_minhash,
    "op2_warc": warc.op2_warc,
    "op3_chat": chat.op3_chat,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality": quality.op5_quality,
    "op6_pii": pii.op6_pii,
    "op7_substring": substring.op7_substring,
    "op8_mixing": mixing.op8_mixing,
    "op9_media": media.op9_media,
    "op10_topk": topk.op10_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op3_chat": chat.OP3_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_topk": topk.OP10_SQL,
}
