"""Dashboard queries over the review domain."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.operators import dashboard as db
from guestlens.registry import query
from guestlens.sources import domain
from guestlens.sources.domain import DOMAIN_SQL as D

START, END = "1999-01-01", "2000-12-31"  # the reporting window of these queries
IN_WINDOW = f"review_date BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
BUCKET = "CASE WHEN n IS NULL THEN NULL WHEN s / (n * 5.0) > 0.15 THEN 'Positive' WHEN s / (n * 5.0) < -0.15 THEN 'Negative' ELSE 'Neutral' END"


def in_window(reviews):
    return db.optional(reviews, dates=db.between_dates("review_date", START, END))


def windowed(spark, d):
    return in_window(domain.reviews(spark, d))


def windowed_clauses(spark, d):
    return db.of_reviews(domain.clauses(spark, d), in_window(domain.review_rows(spark, d)))


STATS = f"""st AS (SELECT aspect, department, count(*) AS total, count(*) FILTER (sentiment = 'Negative') AS negative, count(*) FILTER (sentiment = 'Negative' AND priority = 3) AS critical,
  count(*) FILTER (sentiment = 'Negative' AND priority = 2) AS high, count(*) FILTER (sentiment = 'Negative' AND priority = 1) AS medium, count(*) FILTER (sentiment = 'Negative' AND priority = 0) AS info
  FROM cl JOIN rv USING (review_id) WHERE {IN_WINDOW} GROUP BY 1, 2)"""


@query("agg_aspect_stats", D + STATS + " SELECT * FROM st")
def agg_aspect_stats(spark, d):
    return db.aspect_stats(windowed_clauses(spark, d))


@query(
    "agg_topic_fold",
    D + STATS + """, f AS (SELECT *, CASE WHEN aspect IS NULL OR trim(aspect) = '' OR lower(aspect) IN ('standard', 'general', 'other') THEN '__generic__' ELSE aspect END AS topic FROM st),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY negative DESC, department) AS rn FROM f),
    t AS (SELECT topic, CAST(sum(total) AS BIGINT) AS total, CAST(sum(negative) AS BIGINT) AS negative, sum(critical) AS c, sum(high) AS h, sum(medium) AS m, max(CASE WHEN rn = 1 THEN department END) AS dep,
            round_even(100.0 * sum(negative) / sum(total), 1) AS ratio FROM r GROUP BY 1 HAVING sum(negative) > 0),
    k AS (SELECT *, row_number() OVER (ORDER BY topic = '__generic__', negative DESC, ratio DESC, topic) AS n FROM t)
    SELECT topic, CASE WHEN topic <> '__generic__' THEN dep END AS department, total, negative, ratio,
      CASE WHEN c > 0 THEN 'Critical' WHEN h > 0 THEN 'High' WHEN m > 0 THEN 'Medium' ELSE 'Info' END AS top_priority, CAST(topic = '__generic__' AS INT) AS is_generic
    FROM k WHERE topic = '__generic__' OR n <= 4""",
)
def agg_topic_fold(spark, d):
    return db.complaint_topics(db.aspect_stats(windowed_clauses(spark, d)))


# DuckDB has no time zone rules here; all dates are midnights, which stay on their day anywhere east of UTC (tests hold the zone rule)
DAILY = f"""dy AS (SELECT CAST(review_date + INTERVAL 2 HOUR AS DATE) AS day, count(*) AS reviews, CAST(sum(rating) AS BIGINT) AS rating_sum,
  count(*) FILTER (b = 'Positive') AS positive, count(*) FILTER (b = 'Negative') AS negative, count(*) FILTER (b = 'Neutral') AS neutral, count(*) FILTER (b IS NULL) AS unanalysed
  FROM (SELECT rv.*, {BUCKET} AS b FROM rv LEFT JOIN av USING (review_id) WHERE {IN_WINDOW}) GROUP BY 1)"""


@query("agg_daily_review_stats", D + DAILY + " SELECT * FROM dy")
def agg_daily_review_stats(spark, d):
    return db.daily_stats(in_window(domain.review_rows(spark, d)), domain.scored_clauses(spark, d))


DENSE = DAILY + """, dn AS (SELECT CAST(g.day AS DATE) AS day, coalesce(reviews, 0) AS reviews, coalesce(rating_sum, 0) AS rating_sum, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, coalesce(unanalysed, 0) AS unanalysed
  FROM (SELECT unnest(generate_series((SELECT min(day) FROM dy), (SELECT max(day) FROM dy), INTERVAL 1 DAY)) AS day) g LEFT JOIN dy ON CAST(g.day AS DATE) = dy.day)"""


@query("win_gap_fill", D + DENSE + " SELECT * FROM dn")
def win_gap_fill(spark, d):
    return db.dense_days(agg_daily_review_stats(spark, d))


@query(
    "win_moving_avg_7d",
    D + DENSE + """ SELECT day, reviews, CASE WHEN reviews > 0 THEN round_even(rating_sum / reviews, 2) END AS average,
    CASE WHEN sum(reviews) OVER w > 0 THEN round_even(sum(rating_sum) OVER w / sum(reviews) OVER w, 2) END AS average_7d FROM dn WINDOW w AS (ORDER BY day ROWS 6 PRECEDING)""",
)
def win_moving_avg_7d(spark, d):
    return db.moving_average(win_gap_fill(spark, d))


@query(
    "win_period_stats",
    D + DENSE + ", a AS (SELECT *, CASE WHEN reviews > 0 THEN round_even(rating_sum / reviews, 2) END AS average FROM dn) SELECT round_even(sum(rating_sum) / sum(reviews), 2) AS period_average, min(average) AS lowest, max(average) AS highest FROM a",
)
def win_period_stats(spark, d):
    m = win_gap_fill(spark, d)
    daily = F.when(F.col("reviews") > 0, F.bround(F.col("rating_sum") / F.col("reviews"), 2))
    return m.agg(F.bround(F.sum("rating_sum") / F.sum("reviews"), 2).alias("period_average"), F.min(daily).alias("lowest"), F.max(daily).alias("highest"))


@query(
    "agg_summary_kpi",
    D + f"""x AS (SELECT rating, n, {BUCKET} AS b FROM rv LEFT JOIN av USING (review_id)) SELECT count(*) AS total_reviews, round_even(avg(rating), 1) AS average_rating, count(*) FILTER (b = 'Negative') AS negative_reviews,
    round_even(100.0 * count(*) FILTER (b = 'Negative') / count(*), 1) AS negative_ratio, count(n) AS analysed_reviews FROM x""",
)
def agg_summary_kpi(spark, d):
    return db.kpi(domain.review_rows(spark, d), domain.scored_clauses(spark, d))


CATEGORY = """SELECT aspect AS category, count(*) AS total, count(*) FILTER (sentiment = 'Negative') AS negative, round_even(100.0 * count(*) FILTER (sentiment = 'Negative') / count(*), 1) AS ratio,
  CAST(aspect IS NULL OR trim(aspect) = '' OR lower(aspect) IN ('standard', 'general', 'other') AS INT) AS uncategorised FROM cl GROUP BY 1"""


@query("agg_category_stats", D.rstrip().rstrip(",") + CATEGORY)
def agg_category_stats(spark, d):
    return db.category_stats(domain.clauses(spark, d))


@query("agg_category_distribution", D + f"c AS ({CATEGORY}) SELECT CASE WHEN uncategorised = 1 THEN 'Uncategorised' ELSE category END AS category, total, negative, ratio, row_number() OVER (ORDER BY uncategorised, total DESC, category) AS position FROM c WHERE total > 0")
def agg_category_distribution(spark, d):
    c = agg_category_stats(spark, d).where("total > 0")
    # one row per category name: the ordering window is over the finished aggregate
    place = F.row_number().over(W.orderBy("uncategorised", F.desc("total"), "category")).cast("bigint")
    return c.select(F.when(F.col("uncategorised") == 1, "Uncategorised").otherwise(F.col("category")).alias("category"), "total", "negative", "ratio", place.alias("position"))


@query("srt_flag_last", D.rstrip().rstrip(",") + f" SELECT category, uncategorised FROM ({CATEGORY}) ORDER BY uncategorised, total DESC, category")
def srt_flag_last(spark, d):
    return agg_category_stats(spark, d).orderBy("uncategorised", F.desc("total"), "category").select("category", "uncategorised")


@query("flt_date_range", D.rstrip().rstrip(",") + f" SELECT review_id, rating FROM rv WHERE {IN_WINDOW}")
def flt_date_range(spark, d):
    return windowed(spark, d).select("review_id", "rating")


@query("flt_default_window", D.rstrip().rstrip(",") + " SELECT review_id FROM rv, (SELECT max(review_date) AS m FROM rv) WHERE review_date BETWEEN m - INTERVAL 30 DAY AND m")
def flt_default_window(spark, d):
    r = domain.review_rows(spark, d)
    last = F.broadcast(r.agg(F.max("review_date").alias("last")))  # "now" is the newest review: one row
    return r.join(last, F.col("review_date").between(F.col("last") - F.expr("INTERVAL 30 DAYS"), F.col("last"))).select("review_id")


@query("flt_optional", D.rstrip().rstrip(",") + " SELECT review_id FROM rv WHERE source = 'O' AND rating >= 4")
def flt_optional(spark, d):
    return db.optional(domain.reviews(spark, d), source=F.col("source") == "O", rating=F.col("rating") >= 4, hotel=None).select("review_id")


@query("flt_scope_rls", D.rstrip().rstrip(",") + " SELECT 'HotelAdmin' AS role, count(*) AS visible FROM rv WHERE hotel_id = 3 UNION ALL SELECT 'SuperAdmin', count(*) FROM rv UNION ALL SELECT 'Guest', 0 UNION ALL SELECT 'DepartmentManager', (SELECT count(*) FROM rv WHERE hotel_id = 3)")
def flt_scope_rls(spark, d):
    r, out = domain.reviews(spark, d), None
    for role, hotel, dep in (("HotelAdmin", 3, None), ("SuperAdmin", None, None), ("Guest", 3, None), ("DepartmentManager", 3, "Brand#1")):
        seen, _ = db.scope(role, hotel, dep)
        one = db.optional(r, scope=seen).agg(F.count("*").alias("visible")).select(F.lit(role).alias("role"), "visible")
        out = one if out is None else out.unionByName(one)
    return out


@query("flt_scope_clause_vs_review", D.rstrip().rstrip(",") + " SELECT (SELECT count(*) FROM cl WHERE department = 'Brand#7') AS clauses, (SELECT count(*) FROM rv WHERE EXISTS (SELECT 1 FROM cl WHERE cl.review_id = rv.review_id AND department = 'Brand#7')) AS reviews")
def flt_scope_clause_vs_review(spark, d):
    own = domain.clauses(spark, d).where("department = 'Brand#7'")
    return own.agg(F.count("*").alias("clauses")).join(domain.reviews(spark, d).join(own, "review_id", "left_semi").agg(F.count("*").alias("reviews")), how="inner", on=F.lit(True))


@query("flt_reviews_multi", D + f"x AS (SELECT rv.*, {BUCKET} AS b FROM rv JOIN av USING (review_id)) SELECT review_id FROM x WHERE {IN_WINDOW} AND source = 'F' AND b = 'Negative' AND EXISTS (SELECT 1 FROM cl WHERE cl.review_id = x.review_id AND aspect = 'PROMO') AND hotel_id < 10")
def flt_reviews_multi(spark, d):
    c = domain.clauses(spark, d)
    r = windowed(spark, d).where("source = 'F' AND hotel_id < 10").join(db.review_scores(c), "review_id").where(db.bucket(F.col("s"), F.col("n")) == "Negative")
    return r.join(c.where("aspect = 'PROMO'"), "review_id", "left_semi").select("review_id")


@query("flt_sentiment_bucket", D + f"x AS (SELECT {BUCKET} AS bucket FROM rv JOIN av USING (review_id)) SELECT bucket, count(*) AS n FROM x GROUP BY 1")
def flt_sentiment_bucket(spark, d):
    r = domain.reviews(spark, d).join(db.review_scores(domain.clauses(spark, d)), "review_id")
    return r.groupBy(db.bucket(F.col("s"), F.col("n")).alias("bucket")).agg(F.count("*").alias("n"))


@query("flt_in_list_or_null", "SELECT doc_id FROM documents WHERE lang IN ('tr', 'de') OR lang IS NULL OR lang = ''")
def flt_in_list_or_null(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(F.col("lang").isin("tr", "de") | F.col("lang").isNull() | (F.col("lang") == "")).select("doc_id")


@query("win_first_per_group", D + "r AS (SELECT aspect, review_id, clause_index, category_id, priority, score5, row_number() OVER (PARTITION BY aspect ORDER BY priority DESC, score5, review_id, clause_index, category_id, reviewer_id, price) AS rn FROM cl WHERE sentiment = 'Negative') SELECT aspect, review_id, clause_index, category_id, priority, score5 FROM r WHERE rn = 1")
def win_first_per_group(spark, d):
    c = domain.clauses(spark, d).where("sentiment = 'Negative'")
    # min_by is aggregated partially, so one hot aspect isn't sorted in one task
    key = F.struct((-F.col("priority")).alias("p"), "score5", "review_id", "clause_index", "category_id", "reviewer_id", "price")
    return c.groupBy("aspect").agg(F.min(key).alias("k")).select("aspect", "k.review_id", "k.clause_index", "k.category_id", (-F.col("k.p")).alias("priority"), "k.score5")


@query("srt_topic_clauses", D.rstrip().rstrip(",") + " SELECT review_id, clause_index, priority, score5 FROM cl JOIN rv USING (review_id) WHERE aspect = 'PROMO' AND sentiment = 'Negative' ORDER BY priority DESC, score5, review_date DESC, review_id, clause_index, category_id, reviewer_id LIMIT 50")
def srt_topic_clauses(spark, d):
    c = domain.clauses(spark, d).where("aspect = 'PROMO' AND sentiment = 'Negative'").join(domain.reviews(spark, d), "review_id")
    return c.orderBy(F.desc("priority"), "score5", F.desc("review_date"), "review_id", "clause_index", "category_id", "reviewer_id").limit(50).select("review_id", "clause_index", "priority", "score5")


@query("srt_page", D.rstrip().rstrip(",") + " SELECT review_id, rating FROM rv ORDER BY review_date DESC, review_id LIMIT 20 OFFSET 40")
def srt_page(spark, d):
    return db.page(domain.reviews(spark, d), [F.desc("review_date"), "review_id"], 3, 20).select("review_id", "rating")


MODES = {"newest": ([F.desc, "review_date"], "review_date DESC"), "oldest": (["review_date"], "review_date"), "highest": ([F.desc, "rating"], "rating DESC, review_date DESC"), "lowest": (["rating"], "rating, review_date DESC")}
MODE_SQL = {"newest": "review_date DESC, review_id", "oldest": "review_date, review_id", "highest": "rating DESC, review_date DESC, review_id", "lowest": "rating, review_date DESC, review_id"}


@query("srt_reviews_modes", D.rstrip().rstrip(",") + " " + " UNION ALL ".join(f"(SELECT '{m}' AS mode, review_id FROM rv ORDER BY {o} LIMIT 5)" for m, o in MODE_SQL.items()))
def srt_reviews_modes(spark, d):
    r, out = domain.reviews(spark, d), None
    for m, o in MODE_SQL.items():
        cols = [F.desc(x.split()[0]) if x.endswith("DESC") else F.asc(x) for x in o.split(", ")]
        one = r.orderBy(*cols).limit(5).select(F.lit(m).alias("mode"), "review_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("srt_topn_plus_generic", D + STATS + ", g AS (SELECT CASE WHEN lower(aspect) IN ('standard', 'general', 'other') THEN '__generic__' ELSE aspect END AS topic, CAST(sum(negative) AS BIGINT) AS negative FROM st GROUP BY 1) SELECT * FROM (SELECT * FROM g WHERE topic <> '__generic__' ORDER BY negative DESC, topic LIMIT 3) UNION ALL SELECT * FROM g WHERE topic = '__generic__'")
def srt_topn_plus_generic(spark, d):
    s = db.aspect_stats(windowed_clauses(spark, d))
    g = s.groupBy(F.when(db.is_generic(F.col("aspect")), "__generic__").otherwise(F.col("aspect")).alias("topic")).agg(F.sum("negative").alias("negative"))
    return g.where("topic <> '__generic__'").orderBy(F.desc("negative"), "topic").limit(3).unionByName(g.where("topic = '__generic__'"))


@query("agg_category_tags", D + "g AS (SELECT review_id, coalesce(aspect, 'Other') AS name, sum(score5) AS s, count(*) AS n FROM cl GROUP BY 1, 2) SELECT review_id, string_agg(name, ', ' ORDER BY name) AS tags, CAST(count(*) AS BIGINT) AS n_tags, round_even(min(s / (n * 5.0)), 3) AS worst FROM g GROUP BY 1")
def agg_category_tags(spark, d):
    g = domain.clauses(spark, d).groupBy("review_id", F.coalesce("aspect", F.lit("Other")).alias("name")).agg(F.sum("score5").alias("s"), F.count("*").alias("n"))
    return g.groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("tags"), F.count("*").alias("n_tags"), F.bround(F.min(F.col("s") / (F.col("n") * 5.0)), 3).alias("worst"))


@query("agg_overall_sentiment", D + "g AS (SELECT review_id, count(*) AS n, count(*) FILTER (sentiment = 'Positive') AS p, count(*) FILTER (sentiment = 'Negative') AS g, count(*) FILTER (sentiment = 'Negative' AND priority = 3) AS c FROM cl GROUP BY 1) SELECT CASE WHEN c > 0 AND g >= p THEN 'Negative' WHEN p > 0 AND g > 0 THEN 'Mixed' WHEN g > 0 THEN 'Negative' WHEN p > 0 THEN 'Positive' ELSE 'Neutral' END AS overall, count(*) AS reviews FROM g GROUP BY 1")
def agg_overall_sentiment(spark, d):
    neg, pos = F.col("sentiment") == "Negative", F.col("sentiment") == "Positive"
    g = domain.clauses(spark, d).groupBy("review_id").agg(F.count_if(pos).alias("p"), F.count_if(neg).alias("g"), F.count_if(neg & (F.col("priority") == 3)).alias("c"))
    overall = F.when((F.col("c") > 0) & (F.col("g") >= F.col("p")), "Negative").when((F.col("p") > 0) & (F.col("g") > 0), "Mixed").when(F.col("g") > 0, "Negative").when(F.col("p") > 0, "Positive").otherwise("Neutral")
    return g.groupBy(overall.alias("overall")).agg(F.count("*").alias("reviews"))


@query("agg_max_severity", D.rstrip().rstrip(",") + " SELECT department, CASE max(priority) WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Info' END AS worst FROM cl WHERE sentiment = 'Negative' GROUP BY 1")
def agg_max_severity(spark, d):
    m = domain.clauses(spark, d).where("sentiment = 'Negative'").groupBy("department").agg(F.max("priority").alias("p"))
    names = F.create_map(*[x for k, v in domain.PRIORITIES.items() for x in (F.lit(k), F.lit(v))])
    return m.select("department", F.element_at(names, F.col("p")).alias("worst"))
