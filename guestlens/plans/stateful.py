"""Window, stateful and operational queries over events, comments and clauses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.operators import relational as rel
from guestlens.operators import ordered as od
from guestlens.operators import stateful as st
from guestlens.registry import query
from guestlens.sources import domain
from guestlens.sources.domain import DOMAIN_SQL as D
from guestlens.sources.tables import table

ONLY = D.rstrip().rstrip(",")
KIND = "CASE event_type WHEN 'error' THEN 'report' WHEN 'purchase' THEN 'resolve' WHEN 'signup' THEN 'schedule' END"


def events(spark, d):
    return table(spark, d, "events")


def key_days(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


DAYS = "dd AS (SELECT event_type AS key, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"
TREND = DAYS + """, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS r FROM dd),
g AS (SELECT key, sum(n) FILTER (r <= 7) / 7 AS rate, CASE WHEN coalesce(sum(n) FILTER (r BETWEEN 8 AND 35), 0) > 0 THEN sum(n) FILTER (r BETWEEN 8 AND 35) / count(*) FILTER (r BETWEEN 8 AND 35) ELSE 0.0 END AS before, count(*) AS days, avg(n) AS mean, stddev_pop(n) AS sd FROM r GROUP BY 1),
c AS (SELECT *, CASE WHEN before = 0 THEN CASE WHEN rate > 0 THEN 100.0 ELSE 0.0 END ELSE (rate - before) / before * 100 END AS change FROM g),
tr AS (SELECT key, days, round_even(change, 1) AS change_pct, CASE WHEN days < 7 THEN 'insufficient_data' WHEN change > 30 AND rate > 1 THEN 'rising' WHEN change < -30 THEN 'declining' ELSE 'stable' END AS trend, CAST(sd > 0 AND abs(rate - mean) > 2 * sd AS INT) AS anomaly FROM c)"""


@query("win_recent_prior", f"WITH {TREND} SELECT * FROM tr")
def win_recent_prior(spark, d):
    return st.key_trend(key_days(spark, d), "key")


@query("win_rank_rising", f"WITH {TREND} SELECT key, change_pct FROM tr ORDER BY change_pct DESC, key LIMIT 3")
def win_rank_rising(spark, d):
    return win_recent_prior(spark, d).orderBy(F.desc("change_pct"), "key").limit(3).select("key", "change_pct")


@query("agg_zscore", f"WITH {DAYS} SELECT key, count(*) AS days, round_even(avg(n), 4) AS mean, round_even(stddev_pop(n), 4) AS sd FROM dd GROUP BY 1")
def agg_zscore(spark, d):
    return key_days(spark, d).groupBy("key").agg(F.count("*").alias("days"), F.bround(F.avg("n"), 4).alias("mean"), F.bround(F.stddev_pop("n"), 4).alias("sd"))


@query("q_trend_mark", f"WITH {DAYS}, s AS (SELECT key, avg(n) AS m, stddev_pop(n) AS sd FROM dd GROUP BY 1) SELECT dd.key, day, n, CAST(sd > 0 AND abs((n - m) / sd) > 2.0 AS INT) AS is_anomaly FROM dd JOIN s USING (key)")
def q_trend_mark(spark, d):
    k = key_days(spark, d)
    s = k.groupBy("key").agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"))
    z = F.abs((F.col("n") - F.col("m")) / F.nullif("sd", F.lit(0.0)))
    return k.join(s, "key").select("key", "day", "n", F.coalesce((z > 2.0).cast("int"), F.lit(0)).alias("is_anomaly"))


@query("q_trend_by_key", f"WITH {DAYS} SELECT day, n FROM dd WHERE key = 'error' ORDER BY day DESC LIMIT 90")
def q_trend_by_key(spark, d):
    return key_days(spark, d).where("key = 'error'").orderBy(F.desc("day")).limit(90).select("day", "n")


@query("q_trend_anomalies", f"WITH {DAYS}, s AS (SELECT key, avg(n) AS m, stddev_pop(n) AS sd FROM dd GROUP BY 1) SELECT key, day FROM dd JOIN s USING (key) WHERE sd > 0 AND abs((n - m) / sd) > 2.0 ORDER BY day DESC, key LIMIT 50")
def q_trend_anomalies(spark, d):
    return q_trend_mark(spark, d).where("is_anomaly = 1").orderBy(F.desc("day"), "key").limit(50).select("key", "day")


@query("q_trend_rising_keys", f"WITH {DAYS}, s AS (SELECT key, avg(n) AS m, stddev_pop(n) AS sd FROM dd GROUP BY 1) SELECT DISTINCT key FROM dd JOIN s USING (key) WHERE sd > 0 AND (n - m) / sd >= 2")
def q_trend_rising_keys(spark, d):
    k = key_days(spark, d)
    s = k.groupBy("key").agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("sd")).where("sd > 0")
    return k.join(s, "key").where((F.col("n") - F.col("m")) / F.col("sd") >= 2).select("key").distinct()


@query("st_trend_counters", "SELECT event_type AS key, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def st_trend_counters(spark, d):
    return key_days(spark, d)


@query("win_bucket_spread", "SELECT event_id, round_even(86400.0 * (row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) - 0.5) / count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)), 3) AS age FROM events")
def win_bucket_spread(spark, d):
    w = W.partitionBy("event_type", F.to_date("ts"))
    k = F.row_number().over(w.orderBy("event_id")) - 0.5
    return events(spark, d).select("event_id", F.bround(86400.0 * k / F.count("*").over(w), 3).alias("age"))


@query("win_monotonic_check", "SELECT user_id, count(*) FILTER (value < p) AS breaks FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def win_monotonic_check(spark, d):
    p = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, d).select("user_id", "value", p.alias("p")).groupBy("user_id").agg(F.count_if(F.col("value") < F.col("p")).alias("breaks"))


FLAGS = "SELECT event_id, n, CAST(n >= 2 AS INT) AS is_repeated, CAST(n >= 5 AS INT) AS is_chronic, CASE WHEN n >= 3 THEN 'rising' WHEN n = 1 THEN 'new' ELSE 'stable' END AS trend FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')"


@query("win_running_count", FLAGS)
def win_running_count(spark, d):
    e = od.positions(events(spark, d).where("event_type = 'error'").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])
    return e.select("event_id", "n", (F.col("n") >= 2).cast("int").alias("is_repeated"), (F.col("n") >= 5).cast("int").alias("is_chronic"), F.when(F.col("n") >= 3, "rising").when(F.col("n") == 1, "new").otherwise("stable").alias("trend"))


@query("st_repeat_flags", f"SELECT trend, count(*) AS n FROM ({FLAGS}) GROUP BY 1")
def st_repeat_flags(spark, d):
    return win_running_count(spark, d).groupBy("trend").agg(F.count("*").alias("n"))


@query("win_adjacent_merge", "WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY 1, 2")
def win_adjacent_merge(spark, d):
    i = od.islands(events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return i.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("win_keep_first_dedupe", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def win_keep_first_dedupe(spark, d):
    return rel.keep_first(events(spark, d).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("win_singleton_filter", D + "c AS (SELECT review_id, department, count(*) AS n FROM cl GROUP BY 1, 2), t AS (SELECT *, count(*) OVER (PARTITION BY review_id) AS k FROM c) SELECT review_id, department FROM t WHERE NOT (n = 1 AND k > 1 AND department = 'Brand#1')")
def win_singleton_filter(spark, d):
    c = domain.clauses(spark, d).groupBy("review_id", "department").agg(F.count("*").alias("n")).withColumn("k", F.count("*").over(W.partitionBy("review_id")))
    return c.where("NOT (n = 1 AND k > 1 AND department = 'Brand#1')").select("review_id", "department")



@query("win_context_carry", "SELECT event_id, last_value(CASE WHEN event_type IN ('error', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM events")
def win_context_carry(spark, d):
    topic = F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type"))
    return st.carried(events(spark, d), "user_id", ["ts", "event_id"], topic, "topic").select("event_id", "topic")


@query("st_context_fill", "SELECT user_id, count(*) FILTER (t IS NULL) AS without_context FROM (SELECT user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM events) GROUP BY 1")
def st_context_fill(spark, d):
    c = st.carried(events(spark, d), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "error", F.col("event_id")), "t")
    return c.groupBy("user_id").agg(F.count_if(F.col("t").isNull()).alias("without_context"))


@query("win_journey_cascade", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), f AS (SELECT user_id, min(k) AS f FROM r WHERE event_type = 'error' GROUP BY 1) SELECT user_id, string_agg(event_type, '>' ORDER BY k) AS cascade FROM r JOIN f USING (user_id) WHERE k BETWEEN f AND f + 2 GROUP BY 1")
def win_journey_cascade(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    r = events(spark, d).select("user_id", "event_type", F.row_number().over(w).alias("k"))
    r = r.withColumn("f", F.min(F.when(F.col("event_type") == "error", F.col("k"))).over(W.partitionBy("user_id"))).where("k BETWEEN f AND f + 2")
    return r.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"]), ">").alias("cascade"))


@query("win_case_trend", "SELECT user_id, count(*) AS n, CASE WHEN count(*) <= 2 THEN 'new' WHEN date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) > 21 THEN 'rising' ELSE 'stable' END AS trend FROM events WHERE event_type = 'error' GROUP BY 1")
def win_case_trend(spark, d):
    g = events(spark, d).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return g.select("user_id", "n", F.when(F.col("n") <= 2, "new").when(F.datediff("b", "a") > 21, "rising").otherwise("stable").alias("trend"))


@query("st_case_memory", "SELECT user_id, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def st_case_memory(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


def jobs(spark, d):
    e = events(spark, d)
    status = F.when(F.col("event_type") == "view", "Pending").when(F.col("event_type") == "click", "Processing").when(F.col("event_type") == "error", "Failed").otherwise("Completed")
    return e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), status.alias("status"))


JOBS = "jb AS (SELECT event_id AS job_id, ts AS created_at, CASE event_type WHEN 'view' THEN 'Pending' WHEN 'click' THEN 'Processing' WHEN 'error' THEN 'Failed' ELSE 'Completed' END AS status FROM events)"
NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query("st_queue_claim", f"WITH {JOBS} SELECT job_id, 'Processing' AS status FROM jb WHERE status = 'Pending' ORDER BY created_at, job_id LIMIT 8")
def st_queue_claim(spark, d):
    return st.claim(jobs(spark, d), 8).select("job_id", "status")


@query("st_queue_reap", f"WITH {JOBS} SELECT CASE WHEN status = 'Processing' AND created_at < {NOW} - INTERVAL 15 MINUTE THEN 'Pending' ELSE status END AS status, count(*) AS n FROM jb GROUP BY 1")
def st_queue_reap(spark, d):
    return st.reap(jobs(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).groupBy("status").agg(F.count("*").alias("n"))


@query("st_retry", "WITH g AS (SELECT user_id AS job_id, count(*) FILTER (event_type = 'error') AS failures, max_by(event_type <> 'error', (ts, event_id)) AS last_ok FROM events WHERE event_id % 7 = user_id % 7 GROUP BY 1) SELECT job_id, failures, CASE WHEN last_ok THEN 'Completed' WHEN failures >= 3 THEN 'Failed' ELSE 'Pending' END AS status, CASE WHEN NOT last_ok AND failures < 3 THEN least(60.0, 3 * pow(2, failures)) END AS backoff_s FROM g".replace("WHERE event_id % 7 = user_id % 7 ", ""))
def st_retry(spark, d):
    a = events(spark, d).select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("attempt_id"), (F.col("event_type") != "error").alias("ok"))
    return st.retried(a)


@query("st_cleanup", f"WITH {JOBS} SELECT job_id FROM jb WHERE NOT (status = 'Completed' AND created_at < {NOW})")
def st_cleanup(spark, d):
    return jobs(spark, d).where(~((F.col("status") == "Completed") & (F.col("created_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))).select("job_id")


@query("q_next_pending", f"WITH {JOBS} SELECT job_id FROM jb WHERE status = 'Pending' ORDER BY created_at, job_id LIMIT 1")
def q_next_pending(spark, d):
    return jobs(spark, d).where("status = 'Pending'").orderBy("created_at", "job_id").limit(1).select("job_id")


@query("q_failed_jobs", f"WITH {JOBS} SELECT job_id FROM jb WHERE status = 'Failed' ORDER BY created_at DESC, job_id LIMIT 100")
def q_failed_jobs(spark, d):
    return jobs(spark, d).where("status = 'Failed'").orderBy(F.desc("created_at"), "job_id").limit(100).select("job_id")


@query("st_issue_fsm", f"WITH e AS (SELECT *, {KIND} AS k FROM events WHERE {KIND} IS NOT NULL) SELECT user_id, min(ts) FILTER (k = 'report') AS first_reported, max(ts) FILTER (k = 'report') AS last_reported, count(*) FILTER (k = 'report') AS reports, CASE max_by(k, (ts, event_id)) WHEN 'resolve' THEN 'resolved' WHEN 'schedule' THEN 'scheduled' ELSE 'open' END AS status FROM e GROUP BY 1")
def st_issue_fsm(spark, d):
    kind = F.when(F.col("event_type") == "error", "report").when(F.col("event_type") == "purchase", "resolve").when(F.col("event_type") == "signup", "schedule")
    return st.issue_states(events(spark, d).where(kind.isNotNull()), ["user_id"], "ts", kind)


@query("st_session_ring", "SELECT user_id, event_id, CAST(slot AS INT) AS slot FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS slot FROM events) WHERE slot <= 10")
def st_session_ring(spark, d):
    return st.ring(events(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "slot")


@query("st_count_trigger", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 5 = 0")
def st_count_trigger(spark, d):
    return od.positions(events(spark, d).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).where("n % 5 = 0").select("event_id")


@query("st_rate_limit", "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def st_rate_limit(spark, d):
    return events(spark, d).groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour").start.cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n")).where("n > 1")


@query("st_dept_counters", ONLY + " SELECT department, count(*) AS total, count(*) FILTER (sentiment = 'Negative') AS negative FROM cl GROUP BY 1")
def st_dept_counters(spark, d):
    return domain.clauses(spark, d).groupBy("department").agg(F.count("*").alias("total"), F.count_if(F.col("sentiment") == "Negative").alias("negative"))


@query("st_assignment_fsm", "SELECT user_id, review_id, max_by(status, (assigned_at, id)) AS status FROM review_assignments GROUP BY 1, 2")
def st_assignment_fsm(spark, d):
    return rel.keep_last(table(spark, d, "review_assignments").select("user_id", "review_id", "status", "assigned_at", "id"), ["user_id", "review_id"], ["assigned_at", "id"]).select("user_id", "review_id", "status")


@query("st_feedback_fsm", "SELECT review_id, user_id, field_name, max_by(action, (created_at, id)) AS action, CASE max_by(action, (created_at, id)) WHEN 'approved' THEN 1.0 WHEN 'corrected' THEN 0.0 END AS score FROM absa_corrections GROUP BY 1, 2, 3")
def st_feedback_fsm(spark, d):
    g = table(spark, d, "absa_corrections").groupBy("review_id", "user_id", "field_name").agg(F.max_by("action", F.struct("created_at", "id")).alias("action"))
    return g.withColumn("score", F.when(F.col("action") == "approved", 1.0).when(F.col("action") == "corrected", 0.0))


@query("st_idempotent", "SELECT count(*) AS n FROM (SELECT DISTINCT review_id FROM scraped_reviews)")
def st_idempotent(spark, d):
    return table(spark, d, "scraped_reviews").dropDuplicates(["review_id"]).agg(F.count("*").alias("n"))


@query("agg_process_health", D + "s AS (SELECT department, aspect, avg(1 + CASE priority WHEN 3 THEN -1.0 WHEN 2 THEN -0.6 WHEN 1 THEN -0.3 ELSE -0.1 END) AS a FROM cl WHERE sentiment = 'Negative' GROUP BY 1, 2), p AS (SELECT department, aspect, round_even((a + 1) / 2 * 100, 0) AS pct FROM s) SELECT department, round_even(avg(pct), 0) AS overall, CASE WHEN avg(pct) >= 70 THEN 'healthy' WHEN avg(pct) >= 40 THEN 'warning' ELSE 'critical' END AS status, min_by(aspect, (pct, aspect)) AS worst FROM p GROUP BY 1")
def agg_process_health(spark, d):
    penalty = F.when(F.col("priority") == 3, -1.0).when(F.col("priority") == 2, -0.6).when(F.col("priority") == 1, -0.3).otherwise(-0.1)
    s = domain.clauses(spark, d).where("sentiment = 'Negative'").groupBy("department", "aspect").agg(F.avg(1 + penalty).alias("a"))
    p = s.withColumn("pct", F.bround((F.col("a") + 1) / 2 * 100, 0))
    return p.groupBy("department").agg(F.bround(F.avg("pct"), 0).alias("overall"), F.when(F.avg("pct") >= 70, "healthy").when(F.avg("pct") >= 40, "warning").otherwise("critical").alias("status"), F.min_by("aspect", F.struct("pct", "aspect")).alias("worst"))


@query("q_entity_report", "SELECT entity_id, count(*) AS comments, count(*) FILTER (NOT is_resolution) AS open_reports, count(*) FILTER (is_resolution) AS resolutions, min(created_at) AS first_at, max(created_at) AS last_at FROM entity_comments GROUP BY 1")
def q_entity_report(spark, d):
    return table(spark, d, "entity_comments").groupBy("entity_id").agg(F.count("*").alias("comments"), F.count_if(~F.col("is_resolution")).alias("open_reports"), F.count_if(F.col("is_resolution")).alias("resolutions"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("q_open_issues_summary", "SELECT issue_type, count(DISTINCT entity_id) AS entities FROM entity_comments WHERE NOT is_resolution GROUP BY 1")
def q_open_issues_summary(spark, d):
    return table(spark, d, "entity_comments").where("NOT is_resolution").select("issue_type", "entity_id").distinct().groupBy("issue_type").agg(F.count("entity_id").alias("entities"))


@query("q_recent_issues_summary", "SELECT id, issue_type FROM entity_comments ORDER BY created_at DESC, id LIMIT 10")
def q_recent_issues_summary(spark, d):
    return table(spark, d, "entity_comments").orderBy(F.desc("created_at"), "id").limit(10).select("id", "issue_type")


@query("q_users_listing", "SELECT username, role FROM users ORDER BY role, display_name, username LIMIT 15")
def q_users_listing(spark, d):
    return table(spark, d, "users").orderBy("role", "display_name", "username").limit(15).select("username", "role")


@query("q_gold_export", "SELECT id, corrected_value FROM absa_corrections WHERE action = 'corrected' ORDER BY created_at DESC, id LIMIT 100")
def q_gold_export(spark, d):
    return table(spark, d, "absa_corrections").where("action = 'corrected'").orderBy(F.desc("created_at"), "id").limit(100).select("id", "corrected_value")


@query("q_hotel_coverage", D + "x AS (SELECT hotel_id, rv.review_id, n FROM rv LEFT JOIN av USING (review_id)) SELECT hotel_id, count(*) AS reviews, count(n) AS analysed FROM x GROUP BY 1")
def q_hotel_coverage(spark, d):
    c = domain.clauses(spark, d).groupBy("review_id").agg(F.count("*").alias("n"))
    return domain.reviews(spark, d).join(c, "review_id", "left").groupBy("hotel_id").agg(F.count("*").alias("reviews"), F.count("n").alias("analysed"))


@query("q_accuracy_tracking", "SELECT strftime(CAST(substr(created_at, 1, 10) AS DATE), '%Y-%m') AS month, count(*) AS n, round_even(100.0 * count(*) FILTER (action = 'approved') / count(*), 1) AS accuracy FROM absa_corrections GROUP BY 1")
def q_accuracy_tracking(spark, d):
    return table(spark, d, "absa_corrections").groupBy(F.substring("created_at", 1, 7).alias("month")).agg(F.count("*").alias("n"), F.bround(100.0 * F.count_if(F.col("action") == "approved") / F.count("*"), 1).alias("accuracy"))


@query("q_categories", "SELECT DISTINCT p_type AS category, p_brand AS department FROM part")
def q_categories(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("department")).distinct()


@query("q_cases_summary", "WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (n >= 2) AS patterns, CAST(sum(n) AS BIGINT) AS occurrences FROM c")
def q_cases_summary(spark, d):
    c = events(spark, d).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("cases"), F.count_if(F.col("n") >= 2).alias("patterns"), F.sum("n").alias("occurrences"))


@query("q_test_page", "SELECT id, (SELECT count(*) FROM platform_reviews) AS total FROM platform_reviews ORDER BY id LIMIT 20 OFFSET 20")
def q_test_page(spark, d):
    p = table(spark, d, "platform_reviews")
    return p.orderBy("id").offset(20).limit(20).select("id", F.lit(p.count()).cast("bigint").alias("total"))
