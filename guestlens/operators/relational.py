"""Relational building blocks: keep-first and keep-last, upserts, diffs, assignment, counting with stable ties.

Unless said otherwise NULL keys are a group of their own, repeated rows count each, empty inputs give empty results, and
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.session import cut_lineage


def keep_first(df: DataFrame, keys: list[str | Column], order: list) -> DataFrame:
    """One row per key: the first in the (total) order. A partial aggregation, so a hot key is never sorted in one task."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.select(F.struct(*df.columns).alias("__row"), *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)], F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("__o"))
    return keyed.groupBy(*names).agg(F.min_by("__row", "__o").alias("__row")).select("__row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the (total) order; NULLs in the order come first."""
    names = [c for c in df.columns]
    return df.select(*keys, F.struct(*names).alias("__row"), F.struct(*order).alias("__o")).groupBy(*keys).agg(F.max_by("__row", "__o").alias("__row")).select("__row.*")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the new rows whose key it lacks."""
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of the same key as a whole; new keys are unique."""
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def audit_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """CREATE, UPDATE and DELETE rows between two states, by a full outer join on the key."""
    o = old.select(key, F.struct(*columns).alias("o"))
    n = new.select(key, F.struct(*columns).alias("n"))
    action = F.when(F.col("o").isNull(), "CREATE").when(F.col("n").isNull(), "DELETE").when(~F.col("o").eqNullSafe(F.col("n")), "UPDATE")
    return o.join(n, key, "full_outer").select(key, action.alias("action")).where("action IS NOT NULL")


def most_common(df: DataFrame, value: str, position: list[str], k: int, by: list[str] | None = None) -> DataFrame:
    """The k most frequent values, ties by first occurrence; per group of `by` if given."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("__first"))
    if not by:
        return counts.orderBy(F.desc("n"), "__first").limit(k).drop("__first")
    w = W.partitionBy(*by).orderBy(F.desc("n"), "__first")
    return counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r", "__first")


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Row numbers from 0 in a global order without one task sorting everything: range partitions, then offsets.

    Offsets come from one count per partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed: range bounds are sampled, and both uses must see the same partitions, also after a lost executor
    ranged = cut_lineage(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("c"))
    offsets = counts.withColumn("__off", F.sum("c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).select("__p", F.coalesce("__off", F.lit(0)).alias("__off"))
    local = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__l", local).join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__l") + F.col("__off")).cast("bigint")).drop("__p", "__l", "__off")


def round_robin(items: DataFrame, order: list[str], workers: DataFrame, worker: str) -> DataFrame:
    """The i-th item goes to worker i mod n, workers in their own order. workers is a dimension (a few rows)."""
    w = workers.select(worker).distinct().withColumn("slot", F.row_number().over(W.orderBy(worker)) - 1)
    n = w.count()
    if not n:
        return items.limit(0).withColumn(worker, F.lit(None).cast("string"))
    return numbered(items, order, "item_no").withColumn("slot", (F.col("item_no") % n).cast("int")).join(w, "slot").drop("slot")


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label of truth or prediction: tp, fp, fn, precision, recall, f1 (0 where a denominator is 0)."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = c.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")))).alias("x")).select("x.*")
    s = both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col("tp") / (F.col(a) + F.col(b))).otherwise(0.0)
    s = s.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def islands(df: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Numbers runs of neighbouring rows with equal values in `same` within each group."""
    w = W.partitionBy(*by).orderBy(*order)
    start = F.lit(False)
    for c in same:
        start = start | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("island", F.sum(F.when(start | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))
