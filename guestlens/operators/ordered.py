"""Order within keys without one task per key: a key that holds a third of all rows is spread over many tasks.

Rows are range-partitioned by key and order, so every partition holds a stretch of each key's rows. Windows run within these
stretches; what crosses their borders (counts, last values) comes from one row per stretch, of which a key has at most as many
as there are partitions. The partitions are checkpointed, as range bounds are sampled and all passes must see the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.session import cut_lineage

PART = "part_"


def stretches(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()))


def joined(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their stretch; NULL keys match."""
    s = summary.select(*[F.col(k).alias(f"key_{k}") for k in keys], F.col(PART).alias("stretch_"), *[c for c in summary.columns if c not in (*keys, PART)])
    on = [F.col(k).eqNullSafe(F.col(f"key_{k}")) for k in keys] + [F.col(PART) == F.col("stretch_")]
    return rows.join(s, on).drop("stretch_", *[f"key_{k}" for k in keys])


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "n", total: str = "total") -> DataFrame:
    """Adds each row's number within its key, from 1, and how many rows the key has. Equal order values are numbered in any order."""
    s = stretches(df, keys, order)
    own = s.groupBy(*keys, PART).agg(F.count("*").alias("c_"))
    before = F.sum("c_").over(W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1))
    own = own.select(*keys, PART, F.coalesce(before, F.lit(0)).alias("before_"), F.sum("c_").over(W.partitionBy(*keys)).alias(total))
    local = s.withColumn("local_", F.row_number().over(W.partitionBy(*keys, PART).orderBy(*order)))
    return joined(local, own, keys).withColumn(name, F.col("local_") + F.col("before_")).drop("local_", "before_", PART)


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the latest earlier non-NULL value within the key; NULL where there is none."""
    s = stretches(df.withColumn("value_", value), keys, order)
    last = F.max_by("value_", F.when(F.col("value_").isNotNull(), F.struct(*order)))
    own = s.groupBy(*keys, PART).agg(last.alias("last_"))
    own = own.select(*keys, PART, F.last("last_", ignorenulls=True).over(W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)).alias("before_"))
    local = s.withColumn("local_", F.last("value_", ignorenulls=True).over(W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)))
    return joined(local, own, keys).withColumn(name, F.coalesce("local_", "before_")).drop("local_", "before_", "value_", PART)


def islands(df: DataFrame, keys: list[str], order: list[str], same: list[str], name: str = "island") -> DataFrame:
    """Adds the number, from 1, of the run of rows that agree on `same` (NULL agrees with NULL) within the key."""
    s = stretches(df.withColumn("same_", F.struct(*same)), keys, order)
    w = W.partitionBy(*keys, PART).orderBy(*order)
    s = s.withColumn("local_", F.row_number().over(w)).withColumn("starts_", F.when(F.col("local_") > 1, (~F.lag("same_").over(w).eqNullSafe(F.col("same_"))).cast("int")).otherwise(0))
    own = s.groupBy(*keys, PART).agg(F.min_by("same_", F.struct(*order)).alias("first_"), F.max_by("same_", F.struct(*order)).alias("last_"), F.sum("starts_").alias("c_"))
    chain = W.partitionBy(*keys).orderBy(PART)
    own = own.withColumn("opens_", (F.row_number().over(chain) == 1) | ~F.lag("last_").over(chain).eqNullSafe(F.col("first_")))
    own = own.withColumn("opens_", F.col("opens_").cast("int"))
    before = F.coalesce(F.sum(F.col("c_") + F.col("opens_")).over(chain.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("opens_")
    own = own.select(*keys, PART, before.alias("before_"))
    local = s.withColumn("runs_", F.sum("starts_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return joined(local, own, keys).withColumn(name, F.col("runs_") + F.col("before_")).drop("runs_", "before_", "local_", "starts_", "same_", PART)
