"""Structured Streaming forms of the stateful operators. Each has a batch counterpart it must agree with.

Extensions over the batch folds: event-time windows with watermarks, so that state is dropped once it can't change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """New parquet files of a folder as a stream; offsets take the place of claiming rows from a queue."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def trend_counters(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts per day and type; days close once the watermark has passed them."""
    w = F.window("ts", "1 day")
    return stream.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("key")).agg(F.count("*").alias("n")).select("key", F.to_date(F.col("window.start")).alias("day"), "n")


def rate_limited(stream: DataFrame, limit: int, span: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Users over the limit in a tumbling window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", span), "user_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("user_id", F.col("window.start").alias("start"), "n")


def sliding_rate(stream: DataFrame, span: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", span, step), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Visits: runs of a user's events with no longer gap than `gap`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first of rows delivered several times within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def issue_states(stream: DataFrame) -> DataFrame:
    """Running state per user: open, scheduled or resolved, with the number of reports. Late events don't turn it back."""
    kinds = {"error": "open", "purchase": "resolved", "signup": "scheduled"}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, status, reports = state.get if state.exists else (0, -1, "", 0)
        for pdf in batches:
            pdf = pdf[pdf.event_type.isin(kinds)]
            reports += int((pdf.event_type == "error").sum())
            for t, e, k in zip(pdf.micros, pdf.event_id, pdf.event_type):
                if (t, e) > (at, last):
                    at, last, status = int(t), int(e), kinds[k]
        if status:
            state.update((at, last, status, reports))
            yield pd.DataFrame({"user_id": [key[0]], "status": [status], "reports": [reports], "at": [at]})

    keyed = stream.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("micros")).groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, status string, reports long, at long", "at long, last long, status string, reports long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Processes all that is there and stops; the checkpoint makes a restart go on where it ended."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def upsert_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Keeps the latest version of each key: every micro-batch is one folder, readers take the newest batch per key."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in ("batch", *keys)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("x")).select(*keys, "x.*")
