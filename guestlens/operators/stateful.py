"""Batch folds of the stateful processes: job queue, retries, issue life-cycle, sessions, trends.

Events are taken in event-time order with the id as tie-break, whatever order they arrived in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.operators import ordered


def claim(jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest pending jobs, as processing."""
    return jobs.where("status = 'Pending'").orderBy("created_at", "job_id").limit(n).withColumn("status", F.lit("Processing"))


def reap(jobs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Jobs processing for longer go back to pending; the others stay."""
    stuck = (F.col("status") == "Processing") & (F.coalesce("updated_at", "created_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("status", F.when(stuck, "Pending").otherwise(F.col("status")))


def retried(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Per job the state after its attempts (job_id, at, ok): Completed, Pending with a back-off, or Failed after `most` failures."""
    g = attempts.groupBy("job_id").agg(F.count_if(~F.col("ok")).alias("failures"), F.max_by("ok", F.struct("at", "attempt_id")).alias("last_ok"))
    status = F.when(F.col("last_ok"), "Completed").when(F.col("failures") >= most, "Failed").otherwise("Pending")
    return g.select("job_id", "failures", status.alias("status"), F.when(status == "Pending", F.least(F.lit(60.0), 3 * F.pow(F.lit(2.0), F.col("failures")))).alias("backoff_s"))


def issue_states(events: DataFrame, keys: list[str], at: str, kind: Column) -> DataFrame:
    """Per issue the state after all events: open on report, scheduled, resolved; with counts and times.

    Only the latest event decides the state, so a partial aggregation does it; no key is sorted.
    """
    e = events.withColumn("__kind", kind)
    g = e.groupBy(*keys).agg(F.min(F.when(F.col("__kind") == "report", F.col(at))).alias("first_reported"), F.max(F.when(F.col("__kind") == "report", F.col(at))).alias("last_reported"), F.count_if(F.col("__kind") == "report").alias("reports"), F.max_by("__kind", F.struct(at, "event_id")).alias("last_kind"))
    return g.withColumn("status", F.when(F.col("last_kind") == "resolve", "resolved").when(F.col("last_kind") == "schedule", "scheduled").otherwise("open")).drop("last_kind")


def ring(events: DataFrame, session: str, at: list[str], n: int = 10) -> DataFrame:
    """The last n events of each session, newest first."""
    return ordered.positions(events, [session], at).withColumn("slot", (F.col("total") - F.col("n") + 1).cast("int")).where(F.col("slot") <= n).drop("n", "total")


def carried(events: DataFrame, session: str, at: list[str], value: Column, name: str) -> DataFrame:
    """The latest earlier non-NULL value within the session."""
    return ordered.carried(events, [session], at, value, name)


def key_trend(days: DataFrame, key: str) -> DataFrame:
    """Per key from (key, day, n): the rate of the last 7 observed days against up to 28 before, with an anomaly flag.

    rising: change over 30 % and more than one a day; declining: under -30 %; fewer than 7 days: insufficient_data.
    """
    r = days.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("day"))))
    g = r.groupBy(key).agg(F.sum(F.when(F.col("r") <= 7, F.col("n"))).alias("recent"), F.sum(F.when(F.col("r").between(8, 35), F.col("n"))).alias("prior"), F.count_if(F.col("r").between(8, 35)).alias("prior_days"), F.count("*").alias("days"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    rate = F.col("recent") / 7
    before = F.when(F.coalesce("prior", F.lit(0)) > 0, F.col("prior") / F.col("prior_days")).otherwise(0.0)
    change = F.when(before == 0, F.when(rate > 0, 100.0).otherwise(0.0)).otherwise((rate - before) / F.nullif(before, F.lit(0.0)) * 100)
    trend = F.when(F.col("days") < 7, "insufficient_data").when((change > 30) & (rate > 1), "rising").when(change < -30, "declining").otherwise("stable")
    return g.select(key, "days", F.bround(change, 1).alias("change_pct"), trend.alias("trend"), ((F.col("sd") > 0) & (F.abs(rate - F.col("mean")) > 2 * F.col("sd"))).cast("int").alias("anomaly"))
