"""Queries for problem 5: sentence boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.llm import sentences
from guestlens.llm.registry import query
from guestlens.sources.tables import table


@query("p5_sentences")
def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "platform_reviews"), "id", "review_text").withColumnRenamed("id", "review_id")


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_sentences(spark, d).select("review_id", F.col("start_pos"))
