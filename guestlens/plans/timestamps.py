"""Queries for problem 3: mixed timestamp notations and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.operators import timestamps as ts
from guestlens.registry import query
from guestlens.sources.tables import table


def _instants(spark: SparkSession, d: str) -> DataFrame:
    values = ts.stacked_values(table(spark, d, "reviews"), table(spark, d, "platform_reviews"), table(spark, d, "scraped_reviews"), table(spark, d, "hotels"))
    return ts.to_instants(values, ts.interval_table(spark, ts.zones_in_use(values)))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ts.found_instants(_instants(spark, d))


@query("p3_status")
def p3_status(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field end in which state."""
    return _instants(spark, d).groupBy("table_name", "field_name", "status").agg(F.count("*").alias("n"), F.min("utc_micros").alias("first_micros"), F.max("utc_micros").alias("last_micros"))
