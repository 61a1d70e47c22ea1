"""The operators' queries, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scansmith.llm import decontaminate, lexical, near_dup, neighbours, packing, quality, repair, secrets, sharding, tokens, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_secrets": secrets.op4_secrets,
    "op5_quality": quality.op5_quality,
    "op6_token_files": tokens.op6_token_files,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_sampled_sharding": sharding.op10_sampled_sharding,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_inner_products": topk.op12_inner_products,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_neighbours": neighbours.OP1_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op12_inner_products": topk.OP12_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
