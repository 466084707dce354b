"""Queries for problem 6: missing or wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.llm import language
from guestlens.llm.registry import query
from guestlens.llm.values import text_values
from guestlens.sources.tables import table

FIELDS = [("reviews", "comment"), ("platform_reviews", "review_text"), ("scraped_reviews", "comment")]


@query("p6_stretches")
def p6_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every text's one-language stretches with their confidence."""
    profiles = language.fitted([(table(spark, d, t), c, "language") for t, c in FIELDS])
    return language.classify(text_values(spark, d, FIELDS, "language"), profiles)


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found_labels(p6_stretches(spark, d)).select("table_name", "record_key", "start_pos", F.col("lang"))
