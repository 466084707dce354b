"""Dashboard aggregates over reviews and clauses. Inputs are DataFrames with the columns of sources.domain.

NULL labels are a group of their own, or fold into the generic one where that is said; averages over nothing are NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.sources.domain import GENERIC_LABELS, NEGATIVE, POSITIVE


def optional(df: DataFrame, **conditions: Column | None) -> DataFrame:
    """The rows that meet every condition given; absent ones add no predicate, so pushdown sees plain filters."""
    return reduce(lambda d, c: d.where(c), [c for c in conditions.values() if c is not None], df)


def between_dates(column: str, start: str | None, end: str | None) -> Column | None:
    """Closed interval; either end may be open."""
    parts = [F.col(column) >= F.lit(start).cast("timestamp_ntz")] * bool(start) + [F.col(column) <= F.lit(end).cast("timestamp_ntz")] * bool(end)
    return reduce(lambda a, b: a & b, parts) if parts else None


def scope(role: str, hotel_id: int | None = None, department: str | None = None) -> tuple[Column | None, Column | None]:
    """Row-level scope as (review predicate, clause predicate). Unknown roles and missing ids see nothing."""
    nothing = F.lit(False)
    if role == "SuperAdmin":
        return None, None
    if role == "HotelAdmin" and hotel_id is not None:
        return F.col("hotel_id") == hotel_id, None
    if role == "DepartmentManager" and hotel_id is not None and department:
        return F.col("hotel_id") == hotel_id, F.col("department") == department
    return nothing, nothing


def is_generic(label: Column) -> Column:
    return label.isNull() | (F.trim(label) == "") | F.lower(label).isin(*GENERIC_LABELS)


def review_scores(clauses: DataFrame) -> DataFrame:
    """Per review the sum and number of clause scores (in fifths, so that sums are exact)."""
    return clauses.groupBy("review_id").agg(F.sum("score5").alias("s"), F.count("*").alias("n"))


def bucket(s: Column, n: Column) -> Column:
    """Positive, Negative or Neutral by the mean score; NULL without clauses."""
    mean = s / (n * 5)
    return F.when(n.isNull(), F.lit(None)).when(mean > POSITIVE, "Positive").when(mean < NEGATIVE, "Negative").otherwise("Neutral")


def aspect_stats(clauses: DataFrame) -> DataFrame:
    """Per aspect and department: totals, negatives, and negatives by priority, in one pass."""
    neg = F.col("sentiment") == "Negative"
    level = lambda k, name: F.count_if(neg & (F.col("priority") == k)).alias(name)
    return clauses.groupBy("aspect", "department").agg(F.count("*").alias("total"), F.count_if(neg).alias("negative"), level(3, "critical"), level(2, "high"), level(1, "medium"), level(0, "info"))


def complaint_topics(stats: DataFrame, top: int = 4) -> DataFrame:
    """Topics by negatives: generic labels fold into one row that always comes last; of the others the top ones.

    Ties go by ratio, then name. The department is the one with most negatives (ties: first by name), NULL for the fold.
    """
    folded = stats.withColumn("topic", F.when(is_generic(F.col("aspect")), F.lit("__generic__")).otherwise(F.col("aspect")))
    w = W.partitionBy("topic").orderBy(F.desc("negative"), "department")
    t = folded.withColumn("r", F.row_number().over(w)).groupBy("topic").agg(
        *[F.sum(c).alias(c) for c in ("total", "negative", "critical", "high", "medium", "info")], F.max(F.when(F.col("r") == 1, F.col("department"))).alias("department")
    )
    t = t.where("negative > 0").withColumn("ratio", F.bround(100.0 * F.col("negative") / F.col("total"), 1))
    t = t.withColumn("generic", F.col("topic") == "__generic__").withColumn("department", F.when(~F.col("generic"), F.col("department")))
    t = t.withColumn("top_priority", F.when(F.col("critical") > 0, "Critical").when(F.col("high") > 0, "High").when(F.col("medium") > 0, "Medium").otherwise("Info"))
    # topics are the finished aggregate, a row per label, so one task ranks them
    place = F.row_number().over(W.partitionBy("generic").orderBy(F.desc("negative"), F.desc("ratio"), "topic"))
    kept = t.withColumn("place", place).where((F.col("place") <= top) | F.col("generic"))
    return kept.select("topic", "department", "total", "negative", "ratio", "top_priority", F.col("generic").cast("int").alias("is_generic"))


def of_reviews(clauses: DataFrame, reviews: DataFrame) -> DataFrame:
    """The clauses of these reviews: what a window leaves out never reaches the aggregate."""
    return clauses.join(reviews.select("review_id"), "review_id", "left_semi")


def daily_stats(reviews: DataFrame, clauses: DataFrame, zone: str = "Europe/Istanbul") -> DataFrame:
    """Per local day: reviews, sum of ratings, and how many are positive, negative, neutral, unanalysed."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("review_date")))
    b = bucket(F.col("s"), F.col("n"))
    joined = reviews.join(review_scores(of_reviews(clauses, reviews)), "review_id", "left").select(day.alias("day"), "rating", b.alias("b"))
    return joined.groupBy("day").agg(
        F.count("*").alias("reviews"), F.sum("rating").alias("rating_sum"), F.count_if(F.col("b") == "Positive").alias("positive"), F.count_if(F.col("b") == "Negative").alias("negative"),
        F.count_if(F.col("b") == "Neutral").alias("neutral"), F.count_if(F.col("b").isNull()).alias("unanalysed"),
    )


def dense_days(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every day from first to last: zero counts where there were none. The calendar comes from two aggregates."""
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    counts = [c for c in daily.columns if c != "day"]
    return span.join(daily, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def moving_average(dense: DataFrame, days: int = 7) -> DataFrame:
    """Trailing count-weighted average rating over calendar days (one row per day, so one window task is bounded by days)."""
    w = W.orderBy("day").rowsBetween(-(days - 1), 0)
    n, s = F.sum("reviews").over(w), F.sum("rating_sum").over(w)
    return dense.select("day", "reviews", F.when(F.col("reviews") > 0, F.bround(F.col("rating_sum") / F.col("reviews"), 2)).alias("average"), F.when(n > 0, F.bround(s / n, 2)).alias("average_7d"))


def kpi(reviews: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row: reviews, mean rating, negative reviews and their share of all reviews, analysed reviews."""
    b = bucket(F.col("s"), F.col("n"))
    joined = reviews.join(review_scores(clauses), "review_id", "left").withColumn("b", b)
    return joined.agg(
        F.count("*").alias("total_reviews"), F.bround(F.avg("rating"), 1).alias("average_rating"), F.count_if(F.col("b") == "Negative").alias("negative_reviews"),
        F.bround(100.0 * F.count_if(F.col("b") == "Negative") / F.count("*"), 1).alias("negative_ratio"), F.count("n").alias("analysed_reviews"),
    )


def category_stats(clauses: DataFrame, name: str = "aspect") -> DataFrame:
    """Per category name (ids repeat): totals, negatives, ratio; the generic ones last."""
    t = clauses.groupBy(F.col(name).alias("category")).agg(F.count("*").alias("total"), F.count_if(F.col("sentiment") == "Negative").alias("negative"))
    return t.select("category", "total", "negative", F.bround(100.0 * F.col("negative") / F.col("total"), 1).alias("ratio"), is_generic(F.col("category")).cast("int").alias("uncategorised"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows (1 to 200) in the given total order."""
    size = max(1, min(200, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
