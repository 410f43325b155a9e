"""The operators' queries over the tables of a folder, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, extraction, fingerprints, languages, mixing, neardup, quality, sharding, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _over(function: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: function(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": _over(fingerprints.op1_query, "documents"),
    "op2_near_duplicates": _over(neardup.op2_query, "documents"),
    "op3_sharding": _over(sharding.op3_query, "documents"),
    "op4_token_counts": _over(tokens.op4_query, "documents"),
    "op5_languages": _over(languages.op5_query, "documents"),
    "op6_token_ids": _over(tokens.op6_query, "documents"),
    "op7_decontamination": _over(decontamination.op7_query, "documents", "benchmark"),
    "op8_quality": _over(quality.op8_query, "documents", "labels"),
    "op9_extraction": _over(extraction.op9_query, "pages"),
    "op10_mixing": _over(mixing.op10_query, "documents"),
}

SQL: dict[str, str] = {
    "op2_near_duplicates": neardup.OP2_SQL,
    "op3_sharding": sharding.OP3_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
