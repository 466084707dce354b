"""Lookups of facts, cases and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from guestlens.registry import query
from guestlens.sources import domain
from guestlens.sources.domain import DOMAIN_SQL as D
from guestlens.sources.tables import table

ONLY = D.rstrip().rstrip(",")
@query("gen_ops_summary", ONLY + ", r AS (SELECT review_id, department, text, row_number() OVER (PARTITION BY review_id ORDER BY 2 * priority + abs(score5) DESC, clause_index, category_id, reviewer_id, price) AS rn FROM cl) SELECT review_id, string_agg(department || ' ' || text, '; ' ORDER BY rn) AS summary FROM r WHERE rn <= 2 GROUP BY 1")
def gen_ops_summary(spark, d):
    key = F.struct((-(2 * F.col("priority") + F.abs("score5"))).alias("s"), "clause_index", "category_id", "reviewer_id", "price", F.concat_ws(" ", "department", "text").alias("t"))
    g = domain.clauses(spark, d).groupBy("review_id").agg(F.slice(F.array_sort(F.collect_list(key)), 1, 2).alias("k"))  # a review's clauses are few
    return g.select("review_id", F.array_join(F.transform("k", lambda x: x["t"]), "; ").alias("summary"))


@query("flt_action_items", ONLY + ", a AS (SELECT cl.review_id, department, hotel_id, clause_index, category_id, reviewer_id FROM cl LEFT JOIN rv USING (review_id) WHERE sentiment = 'Negative') SELECT review_id, clause_index, category_id, reviewer_id FROM a WHERE department = 'Brand#3' AND (hotel_id = 2 OR hotel_id = 7)")
def flt_action_items(spark, d):
    a = domain.clauses(spark, d).where("sentiment = 'Negative' AND department = 'Brand#3'").join(domain.reviews(spark, d), "review_id", "left")
    return a.where("hotel_id = 2 OR hotel_id = 7").select("review_id", "clause_index", "category_id", "reviewer_id")


@query("q_staff_by_dept", "SELECT display_name, username FROM users WHERE is_active = 1 AND role = 'reviewer' ORDER BY display_name, username")
def q_staff_by_dept(spark, d):
    return table(spark, d, "users").where("is_active = 1 AND role = 'reviewer'").orderBy("display_name", "username").select("display_name", "username")


@query("q_case_by_pattern", "SELECT entity_id, count(*) AS n, max(created_at) AS last_seen FROM entity_comments WHERE issue_type = 'priz' GROUP BY 1 ORDER BY last_seen DESC, entity_id LIMIT 20")
def q_case_by_pattern(spark, d):
    g = table(spark, d, "entity_comments").where("issue_type = 'priz'").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))
    return g.orderBy(F.desc("last_seen"), "entity_id").limit(20)


@query("q_case_trending", "SELECT issue_type, count(*) AS n FROM entity_comments GROUP BY 1 ORDER BY n DESC, issue_type LIMIT 5")
def q_case_trending(spark, d):
    return table(spark, d, "entity_comments").groupBy("issue_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("issue_type")).limit(5)


@query("q_incident_by_type", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def q_incident_by_type(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id")


@query("q_incident_open", "SELECT id FROM entity_comments WHERE NOT is_resolution ORDER BY created_at DESC, id LIMIT 50")
def q_incident_open(spark, d):
    return table(spark, d, "entity_comments").where("NOT is_resolution").orderBy(F.desc("created_at"), "id").limit(50).select("id")


@query("q_feedback_by_aof", "SELECT id FROM absa_corrections WHERE review_id = (SELECT min(review_id) FROM absa_corrections) ORDER BY created_at DESC, id")
def q_feedback_by_aof(spark, d):
    c = table(spark, d, "absa_corrections")
    return c.join(F.broadcast(c.agg(F.min("review_id").alias("review_id"))), "review_id", "left_semi").orderBy(F.desc("created_at"), "id").select("id")
