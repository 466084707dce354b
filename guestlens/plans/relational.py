"""Join, set, aggregate and sort catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.functions import text as tx
from guestlens.operators import relational as rel
from guestlens.registry import query
from guestlens.sources import domain
from guestlens.sources.domain import DOMAIN_SQL as D
from guestlens.sources.tables import table

ONLY = D.rstrip().rstrip(",")


@query("jn_inner_fk", "SELECT c.id AS correction_id, u.username, p.hotel_name FROM absa_corrections c JOIN users u ON c.user_id = u.id JOIN platform_reviews p ON c.review_id = p.id")
def jn_inner_fk(spark, d):
    c, u, p = table(spark, d, "absa_corrections"), table(spark, d, "users"), table(spark, d, "platform_reviews")
    return c.join(u, c.user_id == u.id).join(p, c.review_id == p.id).select(c.id.alias("correction_id"), "username", "hotel_name")


@query("jn_left_lookup", "SELECT r.id, h.city, h.country FROM reviews r LEFT JOIN hotels h ON r.hotel_name = h.name")
def jn_left_lookup(spark, d):
    r, h = table(spark, d, "reviews"), table(spark, d, "hotels")
    return r.join(h, r.hotel_name == h.name, "left").select("id", "city", "country")


@query("jn_left_agg", "SELECT u.username, count(a.id) AS assignments, count(*) FILTER (a.status = 'completed') AS done FROM users u LEFT JOIN (SELECT DISTINCT * FROM review_assignments) a ON a.user_id = u.id GROUP BY 1")
def jn_left_agg(spark, d):
    u, a = table(spark, d, "users"), table(spark, d, "review_assignments").distinct()
    counts = a.groupBy("user_id").agg(F.count("id").alias("assignments"), F.count_if(F.col("status") == "completed").alias("done"))  # before the join: a hot user stays small
    return u.join(counts, u.id == counts.user_id, "left").select("username", F.coalesce("assignments", F.lit(0)).alias("assignments"), F.coalesce("done", F.lit(0)).alias("done"))


@query("jn_left_count_per_hotel", "SELECT h.name, count(r.id) AS reviews FROM hotels h LEFT JOIN reviews r ON r.hotel_name = h.name GROUP BY 1")
def jn_left_count_per_hotel(spark, d):
    h, c = table(spark, d, "hotels"), table(spark, d, "reviews").groupBy("hotel_name").agg(F.count("id").alias("reviews"))
    return h.join(c, h.name == c.hotel_name, "left").select("name", F.coalesce("reviews", F.lit(0)).alias("reviews"))


@query("agg_minmax_days", "SELECT n_name AS hotel, count(review_id) AS reviews, min(review_date) AS first_date, max(review_date) AS last_date, count(DISTINCT date_trunc('day', review_date)) AS days FROM nation LEFT JOIN (SELECT o_orderkey AS review_id, c_nationkey, o_orderdate AS review_date FROM orders JOIN customer ON o_custkey = c_custkey) ON c_nationkey = n_nationkey GROUP BY 1")
def agg_minmax_days(spark, d):
    n = table(spark, d, "nation")
    # distinct days first: the count distinct needs no second pass over reviews
    per_day = domain.reviews(spark, d).groupBy("hotel_id", F.date_trunc("day", "review_date").alias("day")).agg(F.count("review_id").alias("c"), F.min("review_date").alias("a"), F.max("review_date").alias("b"))
    r = per_day.groupBy("hotel_id").agg(F.sum("c").alias("reviews"), F.min("a").alias("first_date"), F.max("b").alias("last_date"), F.count("day").alias("days"))
    return n.join(r, n.n_nationkey == r.hotel_id, "left").select(F.col("n_name").alias("hotel"), F.coalesce("reviews", F.lit(0)).alias("reviews"), "first_date", "last_date", F.coalesce("days", F.lit(0)).alias("days"))


@query("jn_anti_left_null", "SELECT p.id FROM platform_reviews p LEFT JOIN review_assignments a ON a.review_id = p.id WHERE a.id IS NULL ORDER BY p.id LIMIT 100")
def jn_anti_left_null(spark, d):
    p, a = table(spark, d, "platform_reviews"), table(spark, d, "review_assignments")
    return p.join(a, p.id == a.review_id, "left_anti").select("id").orderBy("id").limit(100)


@query("jn_anti_not_exists", "SELECT id FROM entity_comments e WHERE review_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.id = e.review_id AND r.is_active)")
def jn_anti_not_exists(spark, d):
    e, r = table(spark, d, "entity_comments").where("review_id IS NOT NULL"), table(spark, d, "reviews").where("is_active")
    return e.join(r, e.review_id == r.id, "left_anti").select("id")


@query("jn_anti_multi", "SELECT id FROM platform_reviews p WHERE NOT EXISTS (SELECT 1 FROM review_assignments a WHERE a.review_id = p.id) AND NOT EXISTS (SELECT 1 FROM absa_corrections c WHERE c.review_id = p.id) AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.id = p.id)")
def jn_anti_multi(spark, d):
    p = table(spark, d, "platform_reviews")
    ids = table(spark, d, "review_assignments").select("review_id").union(table(spark, d, "absa_corrections").select("review_id")).union(table(spark, d, "reviews").select("id"))
    return p.join(ids.distinct().withColumnRenamed("review_id", "id"), "id", "left_anti").select("id")


@query("jn_semi_exists", ONLY + " SELECT review_id FROM rv WHERE EXISTS (SELECT 1 FROM cl WHERE cl.review_id = rv.review_id AND sentiment = 'Negative' AND priority = 3)")
def jn_semi_exists(spark, d):
    return domain.reviews(spark, d).join(domain.clauses(spark, d).where("sentiment = 'Negative' AND priority = 3"), "review_id", "left_semi").select("review_id")


@query("jn_semi_in_subquery", "SELECT id FROM absa_corrections WHERE user_id IN (SELECT id FROM users WHERE role = 'reviewer')")
def jn_semi_in_subquery(spark, d):
    c, u = table(spark, d, "absa_corrections"), table(spark, d, "users").where("role = 'reviewer'").select(F.col("id").alias("user_id"))
    return c.join(u, "user_id", "left_semi").select("id")


@query("jn_semi_hashset", "SELECT row_id FROM scraped_reviews WHERE hotel_name IN (SELECT name FROM hotels WHERE country = 'Greece')")
def jn_semi_hashset(spark, d):
    h = table(spark, d, "hotels").where("country = 'Greece'").select(F.col("name").alias("hotel_name"))
    return table(spark, d, "scraped_reviews").join(h, "hotel_name", "left_semi").select("row_id")


@query("jn_nav_chain", ONLY + " SELECT r_name AS region, department, count(*) AS clauses FROM cl JOIN rv USING (review_id) JOIN nation ON hotel_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def jn_nav_chain(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = domain.clauses(spark, d).join(domain.reviews(spark, d), "review_id").join(n, F.col("hotel_id") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left")
    return c.groupBy(F.col("r_name").alias("region"), "department").agg(F.count("*").alias("clauses"))


@query("jn_dict_lookup_default", "SELECT e.id, coalesce(r.hotel_name, 'Bilinmeyen') AS hotel FROM entity_comments e LEFT JOIN reviews r ON r.id = e.review_id")
def jn_dict_lookup_default(spark, d):
    e, r = table(spark, d, "entity_comments").select("id", "review_id"), table(spark, d, "reviews").select(F.col("id").alias("review_id"), "hotel_name")
    return e.join(r, "review_id", "left").select("id", F.coalesce("hotel_name", F.lit("Bilinmeyen")).alias("hotel"))


@query("jn_correlated_scalar", "SELECT u.id, (SELECT count(*) FROM absa_corrections c WHERE c.user_id = u.id AND c.action = 'skipped') AS skipped FROM users u")
def jn_correlated_scalar(spark, d):
    s = table(spark, d, "absa_corrections").where("action = 'skipped'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("skipped"))
    return table(spark, d, "users").join(s, "id", "left").select("id", F.coalesce("skipped", F.lit(0)).alias("skipped"))


@query("jn_scalar_eq_subquery", "SELECT id FROM review_assignments WHERE user_id = (SELECT min(id) FROM users)")
def jn_scalar_eq_subquery(spark, d):
    table(spark, d, "review_assignments").createOrReplaceTempView("gl_assignments")
    table(spark, d, "users").createOrReplaceTempView("gl_users")
    return spark.sql("SELECT id FROM gl_assignments WHERE user_id = (SELECT min(id) FROM gl_users)")


TERMS = ("carpet", "havlu", "Handtücher", "wifi", "klima", "asansör", "pool", "havuz")


@query("jn_theta_contains", "SELECT t.term, count(*) AS hits FROM reviews r JOIN (SELECT unnest(['carpet', 'havlu', 'Handtücher', 'wifi', 'klima', 'asansör', 'pool', 'havuz']) AS term) t ON contains(r.comment, t.term) GROUP BY 1")
def jn_theta_contains(spark, d):
    # a fixed dictionary is an array in the plan: no nested-loop join
    hits = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.col("comment"), t))
    return table(spark, d, "reviews").select(F.explode(hits).alias("term")).groupBy("term").agg(F.count("*").alias("hits"))


@query("jn_fuzzy_resolve", "WITH k AS (SELECT DISTINCT lower(trim(regexp_replace(corrected_value, '[ _-]+', '_', 'g'))) AS raw, corrected_value FROM absa_corrections WHERE field_type = 'department' AND corrected_value IS NOT NULL), n AS (SELECT unnest(['housekeeping', 'front_office', 'food_beverage', 'spa_wellness', 'technical', 'security', 'animation', 'guest_relations']) AS key), m AS (SELECT corrected_value AS spelling, key, CASE WHEN corrected_value = key THEN 1 WHEN lower(corrected_value) = key THEN 2 WHEN contains(regexp_replace(lower(trim(corrected_value)), '[ _-]+', '_', 'g'), key) THEN 3 END AS tier FROM k, n), r AS (SELECT *, row_number() OVER (PARTITION BY spelling ORDER BY tier, key) AS rn FROM m WHERE tier IS NOT NULL) SELECT spelling, key AS department, CAST(tier AS INT) AS tier FROM r WHERE rn = 1")
def jn_fuzzy_resolve(spark, d):
    keys = "housekeeping front_office food_beverage spa_wellness technical security animation guest_relations".split()
    v = table(spark, d, "absa_corrections").where("field_type = 'department' AND corrected_value IS NOT NULL").select(F.col("corrected_value").alias("spelling")).distinct()
    plain = F.regexp_replace(F.lower(F.trim("spelling")), "[ _-]+", "_")
    tiers = [F.when(F.col("spelling") == k, F.struct(F.lit(1).alias("tier"), F.lit(k).alias("department"))).when(F.lower("spelling") == k, F.struct(F.lit(2).alias("tier"), F.lit(k).alias("department"))).when(F.contains(plain, F.lit(k)), F.struct(F.lit(3).alias("tier"), F.lit(k).alias("department"))) for k in keys]
    return v.withColumn("best", F.array_min(F.array_compact(F.array(*tiers)))).where("best IS NOT NULL").select("spelling", "best.department", "best.tier")


@query("jn_round_robin", "WITH i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM platform_reviews p WHERE NOT EXISTS (SELECT 1 FROM review_assignments a WHERE a.review_id = p.id)), w AS (SELECT username, row_number() OVER (ORDER BY username) - 1 AS slot, count(*) OVER () AS c FROM users) SELECT id, username FROM i JOIN w ON n % c = slot")
def jn_round_robin(spark, d):
    p, a = table(spark, d, "platform_reviews"), table(spark, d, "review_assignments")
    return rel.round_robin(p.join(a, p.id == a.review_id, "left_anti").select("id"), ["id"], table(spark, d, "users"), "username").select("id", "username")


@query("jn_zip_positional", "WITH g AS (SELECT id, generate_subscripts(string_split(comment, ' '), 1) AS pos, unnest(string_split(comment, ' ')) AS w FROM reviews), e AS (SELECT review_id AS id, generate_subscripts(string_split(comment, ' '), 1) AS pos, unnest(string_split(comment, ' ')) AS w FROM entity_comments WHERE review_id IS NOT NULL) SELECT g.id, count(*) AS pairs, count(*) FILTER (g.w = e.w) AS same FROM g JOIN e ON g.id = e.id AND g.pos = e.pos GROUP BY 1")
def jn_zip_positional(spark, d):
    g = table(spark, d, "reviews").select("id", F.posexplode(F.split("comment", " ")).alias("pos", "w"))
    e = table(spark, d, "entity_comments").where("review_id IS NOT NULL").select(F.col("review_id").alias("id"), F.posexplode(F.split("comment", " ")).alias("pos", "w2"))
    return g.join(e, ["id", "pos"]).groupBy("id").agg(F.count("*").alias("pairs"), F.count_if(F.col("w") == F.col("w2")).alias("same"))


@query("jn_cross_entity_self", "WITH o AS (SELECT DISTINCT issue_type, entity_id FROM entity_comments WHERE NOT is_resolution), g AS (SELECT issue_type, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 2) SELECT entity_id, issue_type, n AS sharing FROM o JOIN g USING (issue_type)")
def jn_cross_entity_self(spark, d):
    o = table(spark, d, "entity_comments").where("NOT is_resolution").select("issue_type", "entity_id").distinct()
    return o.join(o.groupBy("issue_type").agg(F.count("*").alias("sharing")).where("sharing >= 2"), "issue_type").select("entity_id", "issue_type", "sharing")


@query("jn_cross_batch_cache", "WITH u AS (SELECT comment, length(comment) - length(replace(comment, ' ', '')) + 1 AS words FROM (SELECT DISTINCT comment FROM entity_comments WHERE comment IS NOT NULL)) SELECT e.id, CAST(u.words AS INT) AS words FROM entity_comments e JOIN u USING (comment)")
def jn_cross_batch_cache(spark, d):
    e = table(spark, d, "entity_comments")
    unique = e.where("comment IS NOT NULL").select("comment").distinct().withColumn("words", F.size(F.split("comment", " ", -1)))
    return e.join(unique, "comment").select("id", "words")


@query("jn_parent_child_link", "SELECT r.id AS parent, string_agg(e.id, ',' ORDER BY e.id) AS children, count(*) AS n FROM reviews r JOIN entity_comments e ON e.review_id = r.id GROUP BY 1")
def jn_parent_child_link(spark, d):
    e, r = table(spark, d, "entity_comments"), table(spark, d, "reviews").select(F.col("id").alias("parent"))
    kids = e.where("review_id IS NOT NULL").join(r, e.review_id == r.parent).select("parent", "id")
    return kids.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("children"), F.count("*").alias("n"))


@query("agg_count_pred", "SELECT count(*) FILTER (rating >= 4) AS good, count(*) FILTER (rating <= 2) AS bad, count(*) FILTER (comment IS NULL OR comment = '') AS empty FROM scraped_reviews")
def agg_count_pred(spark, d):
    return table(spark, d, "scraped_reviews").agg(F.count_if(F.col("rating") >= 4).alias("good"), F.count_if(F.col("rating") <= 2).alias("bad"), F.count_if(F.col("comment").isNull() | (F.col("comment") == "")).alias("empty"))


@query("agg_filter_clause", "SELECT role, count(*) FILTER (WHERE is_active = 1) AS active, count(*) AS total FROM users GROUP BY 1")
def agg_filter_clause(spark, d):
    table(spark, d, "users").createOrReplaceTempView("gl_users")
    return spark.sql("SELECT role, count(*) FILTER (WHERE is_active = 1) AS active, count(*) AS total FROM gl_users GROUP BY role")


@query("agg_progress", "WITH a AS (SELECT DISTINCT * FROM review_assignments) SELECT coalesce(user_id, 'ALL') AS reviewer, count(*) AS total, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress FROM a GROUP BY GROUPING SETS ((user_id), ())")
def agg_progress(spark, d):
    a = table(spark, d, "review_assignments").distinct()
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return a.rollup("user_id").agg(F.count("*").alias("total"), n("completed", "done"), n("pending", "pending"), n("in_progress", "in_progress")).withColumn("reviewer", F.coalesce("user_id", F.lit("ALL"))).drop("user_id")


@query("agg_group_two_keys", "SELECT field_type, action, count(*) AS n FROM absa_corrections GROUP BY 1, 2")
def agg_group_two_keys(spark, d):
    return table(spark, d, "absa_corrections").groupBy("field_type", "action").agg(F.count("*").alias("n"))


@query("agg_lang_counts", "SELECT language, count(*) AS n FROM platform_reviews GROUP BY 1")
def agg_lang_counts(spark, d):
    return table(spark, d, "platform_reviews").groupBy("language").agg(F.count("*").alias("n"))


@query("q_lang_dist", "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM documents GROUP BY 1")
def q_lang_dist(spark, d):
    g = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.bround(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))  # a row per language


@query("agg_user_stats", "WITH a AS (SELECT DISTINCT * FROM review_assignments), m AS (SELECT min(user_id) AS u FROM a) SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'pending') AS pending, round_even(100.0 * count(*) FILTER (status = 'completed') / count(*), 1) AS pct FROM a, m WHERE user_id = u")
def agg_user_stats(spark, d):
    a = table(spark, d, "review_assignments").distinct()
    return a.join(F.broadcast(a.agg(F.min("user_id").alias("user_id"))), "user_id", "left_semi").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "pending").alias("pending"), F.bround(100.0 * F.count_if(F.col("status") == "completed") / F.count("*"), 1).alias("pct"))


@query("agg_multi_table_count", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("reviews", "platform_reviews", "users", "hotels")))
def agg_multi_table_count(spark, d):
    out = None
    for t in ("reviews", "platform_reviews", "users", "hotels"):
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("set_union_all", "SELECT 'scraped' AS origin, platform AS name, count(*) AS n FROM scraped_reviews GROUP BY 2 UNION ALL SELECT 'core', source, count(*) FROM reviews GROUP BY 2")
def set_union_all(spark, d):
    a = table(spark, d, "scraped_reviews").groupBy(F.col("platform").alias("name")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("scraped"))
    return a.unionByName(table(spark, d, "reviews").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("core")))


@query("agg_sentiment_pct", ONLY + " SELECT sentiment, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(*) FROM cl), 1) AS pct FROM cl GROUP BY 1")
def agg_sentiment_pct(spark, d):
    g = domain.clauses(spark, d).groupBy("sentiment").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.bround(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))  # three rows


WORDS = "cl2 AS (SELECT review_id, clause_index, category_id, reviewer_id, sentiment, generate_subscripts(string_split(text, ' '), 1) AS pos, unnest(string_split(text, ' ')) AS word FROM cl)"


def clause_words(spark, d):
    return domain.clauses(spark, d).select("review_id", "clause_index", "category_id", "reviewer_id", "sentiment", "department", F.posexplode(F.split("text", " ")).alias("pos", "word"))


@query("agg_most_common", D + WORDS + ", c AS (SELECT word, count(*) AS n, min((review_id, clause_index, category_id, reviewer_id, pos)) AS f FROM cl2 GROUP BY 1) SELECT word, n FROM c ORDER BY n DESC, f LIMIT 8")
def agg_most_common(spark, d):
    return rel.most_common(clause_words(spark, d), "word", ["review_id", "clause_index", "category_id", "reviewer_id", "pos"], 8)


@query("agg_topk_neg_keywords", D + WORDS + ", c AS (SELECT word, count(*) AS n, min((review_id, clause_index, category_id, reviewer_id, pos)) AS f FROM cl2 WHERE sentiment = 'Negative' GROUP BY 1) SELECT word, n FROM c ORDER BY n DESC, f LIMIT 5")
def agg_topk_neg_keywords(spark, d):
    return rel.most_common(clause_words(spark, d).where("sentiment = 'Negative'"), "word", ["review_id", "clause_index", "category_id", "reviewer_id", "pos"], 5)


@query("agg_dept_sentiment", ONLY + " SELECT department, count(*) FILTER (sentiment = 'Positive') AS positive, count(*) FILTER (sentiment = 'Negative') AS negative, count(*) FILTER (sentiment = 'Neutral') AS neutral, count(*) AS total, round_even(100.0 * count(*) FILTER (sentiment = 'Positive') / count(*), 1) AS positive_rate FROM cl GROUP BY 1")
def agg_dept_sentiment(spark, d):
    n = lambda s: F.count_if(F.col("sentiment") == s)
    return domain.clauses(spark, d).groupBy("department").agg(n("Positive").alias("positive"), n("Negative").alias("negative"), n("Neutral").alias("neutral"), F.count("*").alias("total"), F.bround(100.0 * n("Positive") / F.count("*"), 1).alias("positive_rate"))


LEVELS = ("very_satisfied", "satisfied", "neutral", "dissatisfied", "very_dissatisfied")
LEVEL_SQL = "CASE rating WHEN 5 THEN 'very_satisfied' WHEN 4 THEN 'satisfied' WHEN 3 THEN 'neutral' WHEN 2 THEN 'dissatisfied' ELSE 'very_dissatisfied' END"


@query("agg_satisfaction_breakdown", ONLY + " SELECT hotel_id, count(*) AS total, " + ", ".join(f"count(*) FILTER ({LEVEL_SQL} = '{x}') AS {x}" for x in LEVELS) + " FROM rv GROUP BY 1")
def agg_satisfaction_breakdown(spark, d):
    level = F.when(F.col("rating") == 5, LEVELS[0]).when(F.col("rating") == 4, LEVELS[1]).when(F.col("rating") == 3, LEVELS[2]).when(F.col("rating") == 2, LEVELS[3]).otherwise(LEVELS[4])
    r = domain.reviews(spark, d).withColumn("level", level)
    return r.groupBy("hotel_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("level") == x).alias(x) for x in LEVELS])


@query("agg_two_window", D + "m AS (SELECT max(clause_date) AS e FROM cl), w AS (SELECT department, count(*) FILTER (clause_date > e - INTERVAL 60 DAY AND sentiment = 'Negative') AS r, count(*) FILTER (clause_date <= e - INTERVAL 60 DAY AND clause_date > e - INTERVAL 120 DAY AND sentiment = 'Negative') AS p FROM cl, m GROUP BY 1) SELECT department, r AS recent, p AS prior, CASE WHEN p = 0 AND r > 0 THEN 100.0 WHEN p = 0 THEN 0.0 ELSE round_even(100.0 * (r - p) / p, 1) END AS change, CASE WHEN r > p THEN 'up' WHEN r < p THEN 'down' ELSE 'flat' END AS direction FROM w")
def agg_two_window(spark, d, days=60):
    c = domain.clauses(spark, d)
    c = c.join(F.broadcast(c.agg(F.max("clause_date").alias("end"))))  # one row
    end = F.col("end")
    neg, mid, low = F.col("sentiment") == "Negative", end - F.expr(f"INTERVAL {days} DAYS"), end - F.expr(f"INTERVAL {2 * days} DAYS")
    w = c.groupBy("department").agg(F.count_if(neg & (F.col("clause_date") > mid)).alias("recent"), F.count_if(neg & (F.col("clause_date") <= mid) & (F.col("clause_date") > low)).alias("prior"))
    r, p = F.col("recent"), F.col("prior")
    change = F.when((p == 0) & (r > 0), 100.0).when(p == 0, 0.0).otherwise(F.bround(100.0 * (r - p) / F.nullif(p, F.lit(0)), 1))
    return w.select("department", "recent", "prior", change.alias("change"), F.when(r > p, "up").when(r < p, "down").otherwise("flat").alias("direction"))


@query("agg_recommendations", D + "w AS (SELECT department, unnest(string_split(text, ' ')) AS word FROM cl WHERE sentiment = 'Negative'), k AS (SELECT department, word, count(*) AS n, row_number() OVER (PARTITION BY department ORDER BY count(*) DESC, word) AS r FROM w GROUP BY 1, 2), i AS (SELECT department, count(*) AS issues FROM cl WHERE sentiment = 'Negative' GROUP BY 1) SELECT department, issues, CASE WHEN issues >= 8 THEN 'critical' WHEN issues >= 4 THEN 'high' ELSE 'medium' END AS priority, keywords FROM i JOIN (SELECT department, string_agg(word, ',' ORDER BY r) AS keywords FROM k WHERE r <= 3 GROUP BY 1) USING (department) ORDER BY issues DESC, department LIMIT 8")
def agg_recommendations(spark, d):
    neg = domain.clauses(spark, d).where("sentiment = 'Negative'")
    words = neg.select("department", F.explode(F.split("text", " ")).alias("word")).groupBy("department", "word").agg(F.count("*").alias("n"))
    top = words.withColumn("r", F.row_number().over(W.partitionBy("department").orderBy(F.desc("n"), "word"))).where("r <= 3")
    keys = top.groupBy("department").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ",").alias("keywords"))
    i = neg.groupBy("department").agg(F.count("*").alias("issues"))
    level = F.when(F.col("issues") >= 8, "critical").when(F.col("issues") >= 4, "high").otherwise("medium")
    return i.join(keys, "department").select("department", "issues", level.alias("priority"), "keywords").orderBy(F.desc("issues"), "department").limit(8)


@query("agg_avg_opt", "SELECT hotel_name, count(*) AS n, round_even(avg(rating), 2) AS average FROM reviews GROUP BY 1")
def agg_avg_opt(spark, d):
    return table(spark, d, "reviews").groupBy("hotel_name").agg(F.count("*").alias("n"), F.bround(F.avg("rating"), 2).alias("average"))


@query("agg_dist_dict", "SELECT coalesce(corrected_value, original_value, 'unknown') AS label, count(*) AS n FROM absa_corrections WHERE field_name = 'genel_duygu' GROUP BY 1")
def agg_dist_dict(spark, d):
    return table(spark, d, "absa_corrections").where("field_name = 'genel_duygu'").groupBy(F.coalesce("corrected_value", "original_value", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


@query("agg_training_dist", "WITH t AS (SELECT language AS lang, 'core' AS origin FROM reviews UNION ALL SELECT language, 'platform' FROM platform_reviews) SELECT 'lang' AS dimension, coalesce(lang, '?') AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'origin', origin, count(*) FROM t GROUP BY 2")
def agg_training_dist(spark, d):
    t = table(spark, d, "reviews").select(F.col("language").alias("lang"), F.lit("core").alias("origin")).unionByName(table(spark, d, "platform_reviews").select(F.col("language").alias("lang"), F.lit("platform").alias("origin")))
    pairs = t.select(F.explode(F.array(F.struct(F.lit("lang").alias("dimension"), F.coalesce("lang", F.lit("?")).alias("value")), F.struct(F.lit("origin").alias("dimension"), F.col("origin").alias("value")))).alias("x")).select("x.*")
    return pairs.groupBy("dimension", "value").agg(F.count("*").alias("n"))  # one scan, one aggregation for all dimensions


@query("agg_flag_rate", "WITH f AS (SELECT source, length(text) < 80 AS a, contains(text, '{{') AS b, lang IS NULL AS c FROM documents) SELECT source, count(*) AS rows_seen, count(*) FILTER (a OR b OR c) AS flagged, round_even(100.0 * count(*) FILTER (a OR b OR c) / count(*), 2) AS rate, count(*) FILTER (a) AS short, count(*) FILTER (b) AS template, count(*) FILTER (c) AS no_language FROM f GROUP BY 1")
def agg_flag_rate(spark, d):
    a, b, c = F.length("text") < 80, F.contains(F.col("text"), F.lit("{{")), F.col("lang").isNull()
    g = table(spark, d, "documents").groupBy("source")
    return g.agg(F.count("*").alias("rows_seen"), F.count_if(a | b | c).alias("flagged"), F.bround(100.0 * F.count_if(a | b | c) / F.count("*"), 2).alias("rate"), F.count_if(a).alias("short"), F.count_if(b).alias("template"), F.count_if(c).alias("no_language"))


@query("agg_change_rate", "SELECT user_id, count(*) AS rows_seen, count(*) FILTER (corrected_value IS DISTINCT FROM original_value) AS changed, round_even(100.0 * count(*) FILTER (corrected_value IS DISTINCT FROM original_value) / count(*), 1) AS pct FROM absa_corrections WHERE field_type = 'department' GROUP BY 1")
def agg_change_rate(spark, d):
    ch = ~F.col("corrected_value").eqNullSafe(F.col("original_value"))
    return table(spark, d, "absa_corrections").where("field_type = 'department'").groupBy("user_id").agg(F.count("*").alias("rows_seen"), F.count_if(ch).alias("changed"), F.bround(100.0 * F.count_if(ch) / F.count("*"), 1).alias("pct"))


@query("agg_transitions", "SELECT original_value || ' => ' || corrected_value AS transition, count(*) AS n FROM absa_corrections WHERE original_value <> corrected_value GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def agg_transitions(spark, d):
    t = table(spark, d, "absa_corrections").where("original_value <> corrected_value").groupBy(F.concat_ws(" => ", "original_value", "corrected_value").alias("transition")).agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "transition").limit(10)


@query("agg_accuracy_by_type", "SELECT field_type, count(*) FILTER (action = 'approved') AS approved, count(*) AS total, round_even(100.0 * count(*) FILTER (action = 'approved') / count(*), 1) AS pct FROM absa_corrections GROUP BY 1")
def agg_accuracy_by_type(spark, d):
    ok = F.count_if(F.col("action") == "approved")
    return table(spark, d, "absa_corrections").groupBy("field_type").agg(ok.alias("approved"), F.count("*").alias("total"), F.bround(100.0 * ok / F.count("*"), 1).alias("pct"))


@query("agg_ngram_mining", "WITH t AS (SELECT department, string_split(lower(comment), ' ') AS w FROM entity_comments WHERE comment IS NOT NULL), g AS (SELECT department, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t), c AS (SELECT department, gram, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY n DESC, gram) AS rn FROM c) SELECT department, gram, n FROM r WHERE rn <= 5")
def agg_ngram_mining(spark, d):
    w = F.split(F.lower("comment"), " ")
    t = table(spark, d, "entity_comments").where("comment IS NOT NULL").select("department", w.alias("w")).where("size(w) > 1")
    g = t.select("department", F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))")).alias("gram"))
    c = g.groupBy("department", "gram").agg(F.count("*").alias("n")).where("n >= 3")
    return c.withColumn("r", F.row_number().over(W.partitionBy("department").orderBy(F.desc("n"), "gram"))).where("r <= 5").drop("r")


@query("agg_gold_tiers", "WITH t AS (SELECT CASE WHEN rating IN (1, 5) THEN 'A' WHEN rating IN (2, 4) THEN 'B' ELSE 'C' END AS tier, coalesce(source, '?') AS source, coalesce(language, '?') AS language FROM reviews) SELECT tier, source, language, count(*) AS n FROM t GROUP BY GROUPING SETS ((tier), (tier, source), (tier, language))")
def agg_gold_tiers(spark, d):
    t = table(spark, d, "reviews").select(F.when(F.col("rating").isin(1, 5), "A").when(F.col("rating").isin(2, 4), "B").otherwise("C").alias("tier"), F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("language", F.lit("?")).alias("language"))
    return t.groupingSets([["tier"], ["tier", "source"], ["tier", "language"]], "tier", "source", "language").agg(F.count("*").alias("n"))


LABELLED = "e AS (SELECT lower(trim(original_value)) AS t, lower(trim(corrected_value)) AS p FROM absa_corrections WHERE field_name = 'genel_duygu' AND original_value IS NOT NULL AND corrected_value IS NOT NULL)"


@query("agg_clf_metrics", f"WITH {LABELLED}, l AS (SELECT t AS label FROM e UNION SELECT p FROM e), s AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn FROM l, e GROUP BY 1), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM s) SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round_even(pr, 4) AS precision, round_even(re, 4) AS recall, round_even(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM r")
def agg_clf_metrics(spark, d):
    c = table(spark, d, "absa_corrections").where("field_name = 'genel_duygu' AND original_value IS NOT NULL AND corrected_value IS NOT NULL")
    e = c.select(F.lower(F.trim("original_value")).alias("t"), F.lower(F.trim("corrected_value")).alias("p"))
    r = rel.classification_report(e, "t", "p")
    return r.select("label", "tp", "fp", "fn", *[F.bround(x, 4).alias(x) for x in ("precision", "recall", "f1")])


@query("agg_set_jaccard", "SELECT round_even(avg(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a), b)) / len(list_distinct(list_concat(a, b))) END), 6) AS mean_jaccard FROM (SELECT string_split(r.comment, ' ') AS a, string_split(e.comment, ' ') AS b FROM entity_comments e JOIN reviews r ON r.id = e.review_id WHERE e.comment IS NOT NULL AND r.comment IS NOT NULL)")
def agg_set_jaccard(spark, d):
    e, r = table(spark, d, "entity_comments").select("review_id", F.split("comment", " ").alias("b")).where("b IS NOT NULL"), table(spark, d, "reviews").select(F.col("id").alias("review_id"), F.split("comment", " ").alias("a")).where("a IS NOT NULL")
    return e.join(r, "review_id").agg(F.bround(F.avg(rel.set_jaccard(F.col("a"), F.col("b"))), 6).alias("mean_jaccard"))


@query("agg_modal_value", D + "g AS (SELECT review_id, department, count(*) AS n, min((clause_index, category_id, reviewer_id)) AS f FROM cl GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY n DESC, f) AS rn FROM g) SELECT review_id, max(CASE WHEN rn = 1 THEN department END) AS primary_department, max(CASE WHEN rn = 2 THEN department END) AS secondary_department FROM r WHERE rn <= 2 GROUP BY 1")
def agg_modal_value(spark, d):
    g = domain.clauses(spark, d).groupBy("review_id", "department").agg(F.count("*").alias("n"), F.min(F.struct("clause_index", "category_id", "reviewer_id")).alias("f"))
    ranked = g.withColumn("rn", F.row_number().over(W.partitionBy("review_id").orderBy(F.desc("n"), "f"))).where("rn <= 2")
    return ranked.groupBy("review_id").agg(F.max(F.when(F.col("rn") == 1, F.col("department"))).alias("primary_department"), F.max(F.when(F.col("rn") == 2, F.col("department"))).alias("secondary_department"))


@query("agg_source_stats", "WITH k AS (SELECT DISTINCT ON (lower(trim(comment))) platform FROM scraped_reviews WHERE comment <> '' ORDER BY lower(trim(comment)), row_id) SELECT platform, count(*) AS kept FROM k GROUP BY 1")
def agg_source_stats(spark, d):
    s = table(spark, d, "scraped_reviews").where("comment <> ''").select("row_id", "platform", F.lower(F.trim("comment")).alias("k"))
    return s.groupBy("k").agg(F.min_by("platform", "row_id").alias("platform")).groupBy("platform").agg(F.count("*").alias("kept"))


@query("agg_calibration", "SELECT action, count(*) AS n, round_even(avg(CASE WHEN corrected_value = original_value THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM absa_corrections WHERE corrected_value IS NOT NULL GROUP BY 1")
def agg_calibration(spark, d):
    c = table(spark, d, "absa_corrections").where("corrected_value IS NOT NULL")
    return c.groupBy("action").agg(F.count("*").alias("n"), F.bround(F.avg(F.when(F.col("corrected_value") == F.col("original_value"), 1.0).otherwise(0.0)), 4).alias("accuracy"))


@query("set_distinct", "SELECT DISTINCT lower(platform) AS platform FROM scraped_reviews")
def set_distinct(spark, d):
    return table(spark, d, "scraped_reviews").select(F.lower("platform").alias("platform")).distinct()


@query("set_dedupe_hash_all")
def set_dedupe_hash_all(spark, d):
    """set_dedupe_hash over every comment; without SQL, as the engines fold the case of letters outside ASCII differently."""
    k = F.lower(F.regexp_replace("comment", rf"^[{tx.SPACE}]+|[{tx.SPACE}]+\z", ""))
    s = table(spark, d, "scraped_reviews").where("comment <> ''").select("row_id", F.substring(F.sha2(k, 256), 1, 16).alias("hash"))
    return s.groupBy("hash").agg(F.min("row_id").alias("row_id"))


@query("set_dedupe_id", "SELECT min(row_id) AS row_id FROM scraped_reviews WHERE rating BETWEEN 1 AND 5 AND comment <> '' GROUP BY review_id")
def set_dedupe_id(spark, d):
    s = table(spark, d, "scraped_reviews").where("rating BETWEEN 1 AND 5 AND comment <> ''")
    return rel.keep_first(s.select("row_id", "review_id"), ["review_id"], ["row_id"]).select("row_id")


@query("set_dedupe_norm_priority", "WITH a AS (SELECT comment AS t, 1 AS prio, 'core' AS origin, id FROM reviews UNION ALL SELECT comment, 2, 'entity', id FROM entity_comments), r AS (SELECT *, row_number() OVER (PARTITION BY trim(t) ORDER BY prio, id) AS rn FROM a WHERE trim(t) <> '') SELECT origin, id FROM r WHERE rn = 1")
def set_dedupe_norm_priority(spark, d):
    a = table(spark, d, "reviews").select(F.col("comment").alias("t"), F.lit(1).alias("prio"), F.lit("core").alias("origin"), "id")
    a = a.unionByName(table(spark, d, "entity_comments").select(F.col("comment").alias("t"), F.lit(2).alias("prio"), F.lit("entity").alias("origin"), "id")).where("trim(t) <> ''")
    return rel.keep_first(a, [F.trim("t")], ["prio", "id"]).select("origin", "id")


@query("set_drop_duplicates", "SELECT count(*) AS n FROM (SELECT DISTINCT id, review_id, user_id, status, assigned_at, completed_at FROM review_assignments)")
def set_drop_duplicates(spark, d):
    return table(spark, d, "review_assignments").dropDuplicates().agg(F.count("*").alias("n"))


@query("set_concat_frames", "SELECT id, comment AS text, NULL AS department FROM reviews UNION ALL SELECT id, comment, department FROM entity_comments")
def set_concat_frames(spark, d):
    a = table(spark, d, "reviews").select("id", F.col("comment").alias("text"))
    return a.unionByName(table(spark, d, "entity_comments").select("id", F.col("comment").alias("text"), "department"), allowMissingColumns=True)


@query("set_diff_keys", "SELECT 'missing' AS kind, name FROM (SELECT name FROM hotels EXCEPT SELECT hotel_name FROM reviews) UNION ALL SELECT 'unknown', hotel_name FROM (SELECT hotel_name FROM reviews WHERE hotel_name IS NOT NULL EXCEPT SELECT name FROM hotels)")
def set_diff_keys(spark, d):
    h, r = table(spark, d, "hotels").select("name"), table(spark, d, "reviews").where("hotel_name IS NOT NULL").select(F.col("hotel_name").alias("name"))
    return h.subtract(r).select(F.lit("missing").alias("kind"), "name").unionByName(r.subtract(h).select(F.lit("unknown").alias("kind"), "name"))


@query("set_before_after_diff", "SELECT id, original_value, corrected_value FROM absa_corrections WHERE original_value <> '' AND corrected_value <> '' AND original_value <> corrected_value")
def set_before_after_diff(spark, d):
    return table(spark, d, "absa_corrections").where("original_value <> '' AND corrected_value <> '' AND original_value <> corrected_value").select("id", "original_value", "corrected_value")


@query("flt_soft_delete", "SELECT id FROM reviews WHERE is_active")
def flt_soft_delete(spark, d):
    return table(spark, d, "reviews").where("is_active").select("id")


@query("src_table_scan", "SELECT id, rating FROM reviews WHERE is_active")
def src_table_scan(spark, d):
    return table(spark, d, "reviews").where("is_active").select("id", "rating")


@query("src_point_lookup", "WITH o AS (SELECT min(review_id) AS id FROM entity_comments WHERE review_id IS NOT NULL) SELECT r.id, r.rating, count(e.id) AS comments FROM reviews r JOIN o ON r.id = o.id LEFT JOIN entity_comments e ON e.review_id = r.id GROUP BY 1, 2")
def src_point_lookup(spark, d):
    e = table(spark, d, "entity_comments")
    one = F.broadcast(e.agg(F.min("review_id").alias("review_id")))
    kids = e.join(one, "review_id", "left_semi").groupBy("review_id").agg(F.count("id").alias("comments"))
    return table(spark, d, "reviews").join(one.withColumnRenamed("review_id", "id"), "id", "left_semi").join(kids, F.col("id") == F.col("review_id"), "left").select("id", "rating", F.coalesce("comments", F.lit(0)).alias("comments"))


@query("flt_known_role", "SELECT id FROM users WHERE role IN ('reviewer', 'admin')")
def flt_known_role(spark, d):
    return table(spark, d, "users").where(F.col("role").isin("reviewer", "admin")).select("id")


@query("flt_role_substring", "SELECT id FROM entity_comments WHERE contains(department, 'tech') OR contains(department, 'house')")
def flt_role_substring(spark, d):
    return table(spark, d, "entity_comments").where(F.exists(F.array(F.lit("tech"), F.lit("house")), lambda s: F.contains(F.col("department"), s))).select("id")


@query("flt_disagree", "SELECT id FROM absa_corrections WHERE original_value <> corrected_value")
def flt_disagree(spark, d):
    return table(spark, d, "absa_corrections").where("original_value <> corrected_value").select("id")


@query("flt_min_occurrences", "SELECT entity_id, count(*) AS n FROM entity_comments GROUP BY 1 HAVING count(*) >= 3 ORDER BY max(created_at) DESC, entity_id LIMIT 50")
def flt_min_occurrences(spark, d):
    g = table(spark, d, "entity_comments").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("created_at").alias("m")).where("n >= 3")
    return g.orderBy(F.desc("m"), "entity_id").limit(50).select("entity_id", "n")


@query("flt_time_any_of", "SELECT id FROM review_assignments WHERE (assigned_at >= '2025-01-01' AND assigned_at < '2025-07-01') OR (completed_at >= '2025-01-01' AND completed_at < '2025-07-01')")
def flt_time_any_of(spark, d):
    a = table(spark, d, "review_assignments")
    return a.where(F.exists(F.array("assigned_at", "completed_at"), lambda t: (t >= "2025-01-01") & (t < "2025-07-01"))).select("id")


@query("flt_open_recent_room", "SELECT id FROM entity_comments WHERE NOT is_resolution AND entity_type = 'room' AND (created_at IS NULL OR created_at >= '2025-06-01')")
def flt_open_recent_room(spark, d):
    return table(spark, d, "entity_comments").where("NOT is_resolution AND entity_type = 'room' AND (created_at IS NULL OR created_at >= '2025-06-01')").select("id")


@query("flt_validity_split", "SELECT CASE WHEN comment IS NULL OR length(trim(comment)) < 10 THEN 'comment' WHEN rating IS NULL OR rating < 1 OR rating > 5 THEN 'rating' ELSE 'ok' END AS verdict, count(*) AS n FROM reviews GROUP BY 1")
def flt_validity_split(spark, d):
    verdict = F.when(F.col("comment").isNull() | (F.length(F.trim("comment")) < 10), "comment").when(F.col("rating").isNull() | ~F.col("rating").between(1, 5), "rating").otherwise("ok")
    return table(spark, d, "reviews").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("flt_state_transition", "WITH a AS (SELECT id, l_from, l_to FROM (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'Open' WHEN 'N' THEN 'InProgress' ELSE 'Resolved' END AS l_from, CASE l_linestatus WHEN 'O' THEN 'InProgress' ELSE 'Resolved' END AS l_to FROM lineitem)) SELECT l_from AS state_from, l_to AS state_to, count(*) AS n, CAST((l_from = 'Open' AND l_to <> 'Open') OR (l_from = 'InProgress' AND l_to IN ('Resolved', 'Rejected')) AS INT) AS allowed FROM a GROUP BY 1, 2")
def flt_state_transition(spark, d):
    allowed = [("Open", "InProgress"), ("Open", "Resolved"), ("Open", "Rejected"), ("InProgress", "Resolved"), ("InProgress", "Rejected")]
    m = spark.createDataFrame([(a, b, 1) for a, b in allowed], "state_from string, state_to string, ok int")
    li = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "Open").when(F.col("l_returnflag") == "N", "InProgress").otherwise("Resolved").alias("state_from"), F.when(F.col("l_linestatus") == "O", "InProgress").otherwise("Resolved").alias("state_to"))
    return li.groupBy("state_from", "state_to").agg(F.count("*").alias("n")).join(m, ["state_from", "state_to"], "left").select("state_from", "state_to", "n", F.coalesce("ok", F.lit(0)).alias("allowed"))
