"""Text columns of several tables as one stream of rows (table_name, record_key, field_name, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {"reviews": "id", "platform_reviews": "id", "scraped_reviews": "row_id", "entity_comments": "id"}


def text_values(spark: SparkSession, d: str, fields: list[tuple[str, str]], *extra: str) -> DataFrame:
    """One row per value of the (table, column) pairs; each table is scanned once, with only these columns."""

    def rows(name: str) -> DataFrame:
        columns = [c for t, c in fields if t == name]
        df = spark.read.parquet(f"{d}/{name}.parquet")
        key = F.col(KEYS[name]).cast("string").alias("record_key")
        if len(columns) == 1:
            return df.select(F.lit(name).alias("table_name"), key, F.lit(columns[0]).alias("field_name"), F.col(columns[0]).alias("value"), *extra)
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns])).alias("x")
        return df.select(F.lit(name).alias("table_name"), key, pairs, *extra).select("table_name", "record_key", "x.field_name", "x.value", *extra)

    return reduce(DataFrame.unionByName, [rows(t) for t in dict.fromkeys(t for t, _ in fields)])
