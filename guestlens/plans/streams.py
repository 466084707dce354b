"""Streaming queries, run to the end of what is there; their SQL is that of the batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from guestlens.registry import query
from guestlens.session import scratch_path
from guestlens.sources.tables import table
from guestlens.streaming import jobs


def _stream(spark, d):
    path = scratch_path(spark, "stream")
    table(spark, d, "events").write.parquet(path)
    return jobs.event_stream(spark, path)


def _run(spark, df, keys):
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    jobs.run_to_end(df, "update", ckpt, jobs.upsert_sink(out, keys))
    return jobs.latest(spark, out, keys)


@query("st_stream_trend", "SELECT event_type AS key, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def st_stream_trend(spark, d):
    return _run(spark, jobs.trend_counters(_stream(spark, d), late="60 days"), ["key", "day"])


@query("st_stream_issue_fsm", "SELECT user_id, count(*) FILTER (event_type = 'error') AS reports, CASE max_by(event_type, (ts, event_id)) WHEN 'error' THEN 'open' WHEN 'purchase' THEN 'resolved' ELSE 'scheduled' END AS status FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1")
def st_stream_issue_fsm(spark, d):
    return _run(spark, jobs.issue_states(_stream(spark, d)), ["user_id"]).select("user_id", "reports", "status")


@query("st_worker_loop", "SELECT count(*) AS n FROM events WHERE event_type = 'view'")
def st_worker_loop(spark, d):
    return _run(spark, _stream(spark, d).where("event_type = 'view'").select("event_id", "user_id"), ["event_id"]).agg(F.count("*").alias("n"))
