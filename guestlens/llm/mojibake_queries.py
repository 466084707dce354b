"""Queries for problem 7: garbled text from wrong character encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from guestlens.llm import mojibake
from guestlens.llm.registry import query
from guestlens.llm.values import text_values

FIELDS = [("platform_reviews", "review_text"), ("scraped_reviews", "comment"), ("reviews", "guest_name")]


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_restored(spark, d).select("table_name", "record_key", "field_name")


@query("p7_restored")
def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """The damaged values beside the restored text (NULL: the original can't be had) and the round trips taken."""
    return mojibake.damaged_rows(text_values(spark, d, FIELDS), "value")
