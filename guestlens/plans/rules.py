"""Lookups, reports, similarity joins and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from guestlens.operators import similarity as sim
from guestlens.registry import query
from guestlens.sources import domain
from guestlens.sources.domain import DOMAIN_SQL as D
from guestlens.sources.tables import table

ONLY = D.rstrip().rstrip(",")

@query("cls_priority_legacy", ONLY + " SELECT CASE WHEN sentiment = 'Negative' AND priority >= 2 THEN 'P1' WHEN sentiment = 'Negative' THEN 'P2' WHEN sentiment = 'Neutral' THEN 'P3' ELSE 'P4' END AS level, count(*) AS n FROM cl GROUP BY 1")
def cls_priority_legacy(spark, d):
    s = F.col("sentiment")
    return domain.clauses(spark, d).groupBy(F.when((s == "Negative") & (F.col("priority") >= 2), "P1").when(s == "Negative", "P2").when(s == "Neutral", "P3").otherwise("P4").alias("level")).agg(F.count("*").alias("n"))


@query("txt_vocab_build", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1 HAVING count(*) >= 2")
def txt_vocab_build(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


@query("arr_first_n", "SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word FROM part")
def arr_first_n(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.slice(F.split("p_name", " "), 1, 1), " ").alias("first_word"))


@query("arr_join", "SELECT p_partkey, replace(p_name, ' ', '|') AS joined FROM part")
def arr_join(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.split("p_name", " "), "|").alias("joined"))


@query("dt_sched_date", "SELECT row_id, try_strptime(regexp_extract(date_text, '^([0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})', 1), '%d.%m.%Y')::DATE AS day FROM scraped_reviews WHERE regexp_matches(date_text, '^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}')")
def dt_sched_date(spark, d):
    t = F.regexp_extract("date_text", r"^([0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})", 1)
    return table(spark, d, "scraped_reviews").where(F.col("date_text").rlike(r"^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}")).select("row_id", F.to_date(F.try_to_timestamp(t, F.lit("d.M.yyyy"))).alias("day"))


@query("q_users", "SELECT id FROM users WHERE lower(trim(username)) = (SELECT min(lower(trim(username))) FROM users)")
def q_users(spark, d):
    u = table(spark, d, "users").withColumn("n", F.lower(F.trim("username")))
    return u.join(F.broadcast(u.agg(F.min("n").alias("n"))), "n", "left_semi").select("id")


@query("q_test_detail", "SELECT r.id, string_agg(e.id, ',' ORDER BY e.id) AS children FROM reviews r JOIN entity_comments e ON e.review_id = r.id GROUP BY 1")
def q_test_detail(spark, d):
    e = table(spark, d, "entity_comments").where("review_id IS NOT NULL").groupBy(F.col("review_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("children"))
    return table(spark, d, "reviews").join(e, "id").select("id", "children")


@query("q_test_corrected", "SELECT id FROM absa_corrections WHERE action = 'corrected' AND field_type = 'sentiment'")
def q_test_corrected(spark, d):
    return table(spark, d, "absa_corrections").where("action = 'corrected' AND field_type = 'sentiment'").select("id")


@query("q_test_cascade_delete", "SELECT count(*) AS children_left FROM entity_comments e WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.id = e.review_id AND r.rating = 1)")
def q_test_cascade_delete(spark, d):
    gone = table(spark, d, "reviews").where("rating = 1").select(F.col("id").alias("review_id"))
    return table(spark, d, "entity_comments").join(gone, "review_id", "left_anti").agg(F.count("*").alias("children_left"))


@query("gen_headline", ONLY + ", g AS (SELECT department, count(*) FILTER (sentiment = 'Negative') AS n, count(*) AS t FROM cl GROUP BY 1) SELECT department || ': ' || n || ' of ' || t || ' negative' AS headline FROM g")
def gen_headline(spark, d):
    g = domain.clauses(spark, d).groupBy("department").agg(F.count_if(F.col("sentiment") == "Negative").alias("n"), F.count("*").alias("t"))
    return g.select(F.format_string("%s: %d of %d negative", "department", "n", "t").alias("headline"))


@query("snk_report_md", "SELECT '| ' || status || ' | ' || n || ' |' AS line FROM (SELECT status, count(*) AS n FROM review_assignments GROUP BY 1)")
def snk_report_md(spark, d):
    g = table(spark, d, "review_assignments").groupBy("status").agg(F.count("*").alias("n"))
    return g.select(F.format_string("| %s | %d |", "status", "n").alias("line"))


def similarity_sql(source: str, key: str) -> str:
    """Classes of equal words (cl: rep, key), their shingle sets (sh) and the pairs of Jaccard 0.8 and more (pr: a < b), by brute force over shared shingles."""
    return f"""wd AS (SELECT {key} AS id, list_filter(string_split_regex(lower(comment), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {source} WHERE comment IS NOT NULL), dc AS (SELECT id, array_to_string(w, ' ') AS t, w FROM wd WHERE len(w) > 0), cl AS (SELECT id, t, min(id) OVER (PARTITION BY t) AS rep FROM dc),
    sh AS (SELECT id AS rep, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dc WHERE id IN (SELECT rep FROM cl)), ex AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM sh), sg AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM ex a JOIN ex b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL), pr AS (SELECT a, b FROM sg WHERE c >= 0.8 * (na + nb - c))"""


@query("jn_pairwise_similarity", f"WITH {similarity_sql('reviews', 'id')}, l AS (SELECT a AS rep, b AS o FROM pr UNION ALL SELECT b, a FROM pr), n AS (SELECT rep, count(*) AS n FROM l GROUP BY 1) SELECT cl.id, cl.rep AS class_id, coalesce(n, 0) AS n_links FROM cl LEFT JOIN n USING (rep)")
def jn_pairwise_similarity(spark, d):
    """One row per review: its class of exact copies and how many other classes are similar (Jaccard of five-word shingles at least 0.8)."""
    return sim.links(table(spark, d, "reviews"), "id", "comment").select("id", "class_id", "n_links")


@query("ml_train_sentiment")
def ml_train_sentiment(spark, d):
    """Held-out confusion counts of a logistic regression on hashed words; ratings 1, 2, 4, 5 give the labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    r = table(spark, d, "reviews").where("comment <> '' AND rating IN (1, 2, 4, 5)").select("id", "comment", (F.col("rating") >= 4).cast("double").alias("label"))
    r = r.withColumn("held", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(5)) == 0)
    stages = [RegexTokenizer(inputCol="comment", outputCol="w", pattern=r"[^\p{L}]+"), HashingTF(inputCol="w", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", maxIter=5, regParam=0.1)]
    model = Pipeline(stages=stages).fit(r.where("NOT held"))
    return model.transform(r.where("held")).groupBy("label", "prediction").agg(F.count("*").alias("n"))
