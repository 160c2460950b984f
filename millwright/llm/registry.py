"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millwright.llm import html_text, imatch, mixing, packing, sharding, simhash, token_rollup, toxicity, transport_stream, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": html_text.op1_html_text,
    "op2_token_rollup": token_rollup.op2_token_rollup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_packing": packing.op6_packing,
    "op7_media_columns": transport_stream.op7_media_columns,
    "op8_imatch": imatch.op8_imatch,
    "op9_sharding": sharding.op9_sharding,
    "op10_mixing": mixing.op10_mixing,
}

SQL: dict[str, str] = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
