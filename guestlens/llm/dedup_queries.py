"""Queries for problem 1: new batches against all accepted history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.llm import dedup
from guestlens.llm.registry import query
from guestlens.sources.tables import table


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """History is accepted first, then the new batches; only the new batches' repeats come out."""
    rows = table(spark, d, "scraped_reviews").select("row_id", "batch_no", "comment")
    found = dedup.repeats(spark, rows, [F.col("batch_no") == 0, F.col("batch_no") >= 1])
    return found.where("step >= 1").select("row_id_a", "row_id_b")


@query("p1_batches")
def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same repeats with every batch accepted on its own, in order, into one store: step is the batch's number."""
    rows = table(spark, d, "scraped_reviews").select("row_id", "batch_no", "comment")
    last = rows.agg(F.max("batch_no")).first()[0]  # the batches are accepted one after the other, so their number must be known
    found = dedup.repeats(spark, rows, [F.col("batch_no") == b for b in range((last or 0) + 1)])
    return found.where("step >= 1").select("step", "row_id_a", "row_id_b")
