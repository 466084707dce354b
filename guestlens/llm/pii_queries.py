"""Queries for problem 4: personal information inside free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.llm import pii
from guestlens.llm.registry import query
from guestlens.llm.values import text_values
from guestlens.sources.tables import table

FIELDS = [("reviews", "comment"), ("reviews", "guest_name"), ("entity_comments", "comment")]


@query("p4_redacted")
def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every value with its personal data and the text with typed placeholders."""
    return pii.annotate(text_values(spark, d, FIELDS), pii.gazetteer(table(spark, d, "reviews")))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each piece of personal data, with its kind and first character."""
    found = p4_redacted(spark, d).select("table_name", "record_key", "field_name", F.explode("spans").alias("s"))
    return found.select("table_name", "record_key", "field_name", F.col("s.pii_kind").alias("pii_kind"), F.col("s.start_pos").alias("start_pos"))
