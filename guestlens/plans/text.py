"""Text, scalar and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.functions import text as tx
from guestlens.registry import query
from guestlens.sources import domain
from guestlens.sources.domain import DOMAIN_SQL as D
from guestlens.sources.tables import table

ONLY = D.rstrip().rstrip(",")


@query("txt_normalize", "SELECT id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(translate(comment, 'İI', 'iı')), 'approx.', 'approximately'), 'd / d', 'd/d'), 'bkz.', 'bakınız'), 'vb.', 've benzeri'), '!{4,}', '!!', 'g'), '\\s+', ' ', 'g')) AS norm FROM entity_comments")
def txt_normalize(spark, d):
    return table(spark, d, "entity_comments").select("id", tx.normalize(F.col("comment")).alias("norm"))


@query("txt_abbrev", "SELECT id, replace(replace(replace(replace(comment, 'approx.', 'approximately'), 'd / d', 'd/d'), 'bkz.', 'bakınız'), 'vb.', 've benzeri') AS text FROM entity_comments")
def txt_abbrev(spark, d):
    return table(spark, d, "entity_comments").select("id", tx.abbreviations(F.col("comment")).alias("text"))


@query("txt_collapse_repeat", "SELECT doc_id, length(regexp_replace(regexp_replace(substr(text, 1, 10000000), 'x{4,}', 'xx', 'g'), 'z{4,}', 'zz', 'g')) AS n FROM documents WHERE regexp_matches(text, '^[xz ]+$')")
def txt_collapse_repeat(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("^[xz ]+$")).select("doc_id", F.length(tx.collapse_repeats(F.col("text"))).cast("bigint").alias("n"))


@query("txt_collapse_repeat_all")
def txt_collapse_repeat_all(spark, d):
    """Of every document the text with runs of any character collapsed, and its length; without SQL, as that has no backreferences."""
    text = tx.collapse_vowels(F.regexp_replace("text", r"([^\n])\1{3,}", "$1$1"))
    return table(spark, d, "documents").select("doc_id", text.alias("text"), F.length(text).cast("bigint").alias("n"))


@query("txt_fold", "SELECT id, translate(comment, 'şığüöçŞİĞÜÖÇ', 'siguocSIGUOC') AS folded FROM entity_comments")
def txt_fold(spark, d):
    return table(spark, d, "entity_comments").select("id", tx.fold(F.col("comment")).alias("folded"))


@query("txt_ngrams", "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT string_split(p_name, ' ') AS w FROM part)) GROUP BY 1")
def txt_ngrams(spark, d):
    return table(spark, d, "part").select(F.explode(tx.word_ngrams(F.split("p_name", " "), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("txt_char_ngrams", "SELECT p_partkey, CAST(len(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)))) AS INT) AS grams FROM part")
def txt_char_ngrams(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(tx.char_ngrams(F.col("p_name"))).alias("grams"))


@query("txt_lang_heuristic", "SELECT CASE WHEN regexp_matches(comment, '[а-яА-Я]') THEN 'ru' WHEN regexp_matches(comment, '[ğşıİ]') THEN 'tr' WHEN regexp_matches(comment, '[äß]') THEN 'de' ELSE 'en' END AS lang, count(*) AS n FROM scraped_reviews WHERE comment IS NOT NULL GROUP BY 1")
def txt_lang_heuristic(spark, d):
    c = F.col("comment")
    lang = F.when(c.rlike("[а-яА-Я]"), "ru").when(c.rlike("[ğşıİ]"), "tr").when(c.rlike("[äß]"), "de").otherwise("en")
    return table(spark, d, "scraped_reviews").where("comment IS NOT NULL").groupBy(lang.alias("lang")).agg(F.count("*").alias("n"))


@query("txt_chunk", "SELECT doc_id, CAST(i AS INT) AS chunk, CAST(length(substr(text, i * 4000 + 1, 4000)) AS INT) AS n FROM (SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 1) / 4000) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)")
def txt_chunk(spark, d):
    docs = table(spark, d, "documents").where("length(text) > 0")
    return docs.select("doc_id", F.posexplode(tx.chunks(F.col("text"), 4000)).alias("chunk", "c")).select("doc_id", "chunk", F.length("c").alias("n"))


@query("txt_sentence_split", "SELECT id, CAST(len(list_filter(string_split_regex(comment, '[.!?]+'), lambda s: trim(s) <> '')) AS INT) AS parts FROM reviews WHERE comment IS NOT NULL")
def txt_sentence_split(spark, d):
    return table(spark, d, "reviews").where("comment IS NOT NULL").select("id", F.size(F.filter(F.split("comment", "[.!?]+"), lambda s: F.trim(s) != "")).alias("parts"))


@query("seg_en", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?\\n]+'), lambda s: length(trim(s, ' ')) > 10)) AS INT) AS clauses FROM documents WHERE lang = 'en'")
def seg_en(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.size(F.filter(F.split("text", r"[.!?\n]+"), lambda s: F.length(F.trim(s)) > 10)).alias("clauses"))


CONTRAST = (", but ", ", ama ", ", aber ", ", mais ", ", pero ", ", но ")


CATEGORY_TERMS = [("room", "carpet", 2.0), ("room", "mattress", 2.5), ("room", "bathroom", 2.0), ("food", "breakfast", 2.5), ("food", "restaurant", 2.0), ("food", "snack bar", 1.5), ("pool", "pool", 2.0), ("pool", "sun loungers", 2.5), ("tech", "wifi", 2.0), ("tech", "lift", 2.0), ("tech", "air conditioning", 2.5), ("front", "reception", 2.0), ("front", "manager", 1.0)]
TERMS_SQL = "tm AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}', {w})" for c, t, w in CATEGORY_TERMS) + ") t(category, term, weight))"


@query("cls_en_keyword", f"WITH {TERMS_SQL} SELECT term, count(*) AS documents FROM documents JOIN tm ON contains(text, term) WHERE lang = 'en' GROUP BY 1")
def cls_en_keyword(spark, d):
    hits = F.filter(F.array(*[F.lit(t) for _, t, _ in CATEGORY_TERMS]), lambda t: F.contains(F.col("text"), t))
    return table(spark, d, "documents").where("lang = 'en'").select(F.explode(hits).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))


@query("cls_issue_type", f"WITH {TERMS_SQL}, p AS (SELECT id, term, strpos(comment, term) AS pos FROM entity_comments JOIN tm ON contains(comment, term)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, length(term) DESC, term) AS rn FROM p) SELECT id, term FROM r WHERE rn = 1")
def cls_issue_type(spark, d):
    places = F.array(*[F.struct(F.locate(t, F.col("comment")).alias("pos"), F.lit(-len(t)).alias("n"), F.lit(t).alias("term")) for _, t, _ in CATEGORY_TERMS])
    first = F.array_min(F.filter(places, lambda x: x["pos"] > 0))
    return table(spark, d, "entity_comments").select("id", first["term"].alias("term")).where("term IS NOT NULL")


@query("cls_rating_score", "SELECT rating, CASE CAST(rating AS INT) WHEN 5 THEN 0.9 WHEN 4 THEN 0.5 WHEN 3 THEN 0.0 WHEN 2 THEN -0.5 WHEN 1 THEN -0.9 END AS score, count(*) AS n FROM scraped_reviews GROUP BY 1, 2")
def cls_rating_score(spark, d):
    m = F.create_map(*[F.lit(x) for kv in {5: 0.9, 4: 0.5, 3: 0.0, 2: -0.5, 1: -0.9}.items() for x in kv])
    # rounding as the counterpart does: half to even
    return table(spark, d, "scraped_reviews").groupBy("rating").agg(F.count("*").alias("n")).withColumn("score", F.element_at(m, F.bround("rating").cast("int")))


@query("cls_satisfaction5", ONLY + " SELECT CASE WHEN score5 >= 3 THEN 'very_satisfied' WHEN score5 >= 1 THEN 'satisfied' WHEN score5 = 0 THEN 'neutral' WHEN score5 >= -3 THEN 'dissatisfied' ELSE 'very_dissatisfied' END AS level, count(*) AS n FROM cl GROUP BY 1")
def cls_satisfaction5(spark, d):
    s = F.col("score5")
    level = F.when(s >= 3, "very_satisfied").when(s >= 1, "satisfied").when(s == 0, "neutral").when(s >= -3, "dissatisfied").otherwise("very_dissatisfied")
    return domain.clauses(spark, d).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("cls_severity", ONLY + " SELECT CASE WHEN sentiment = 'Positive' AND score5 >= 3 THEN 'info' WHEN sentiment = 'Positive' THEN 'low' WHEN sentiment = 'Neutral' THEN 'medium' WHEN priority = 3 THEN 'critical' WHEN score5 <= -3 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM cl GROUP BY 1")
def cls_severity(spark, d):
    s, f = F.col("sentiment"), F.col("score5")
    level = F.when((s == "Positive") & (f >= 3), "info").when(s == "Positive", "low").when(s == "Neutral", "medium").when(F.col("priority") == 3, "critical").when(f <= -3, "high").otherwise("medium")
    return domain.clauses(spark, d).groupBy(level.alias("severity")).agg(F.count("*").alias("n"))


@query("cls_calibrate", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN least(0.98, 0.98 * x) WHEN 'PROMO' THEN least(0.75, 0.85 * x) WHEN 'LARGE' THEN least(0.85, 0.9 * x) ELSE least(0.9, x) END AS confidence FROM (SELECT *, p_size / 50.0 AS x FROM part)")
def cls_calibrate(spark, d):
    x, t = F.col("p_size") / F.lit(50.0), F.col("p_type")
    c = F.when(t == "ECONOMY", F.least(F.lit(0.98), 0.98 * x)).when(t == "PROMO", F.least(F.lit(0.75), 0.85 * x)).when(t == "LARGE", F.least(F.lit(0.85), 0.9 * x)).otherwise(F.least(F.lit(0.9), x))
    return table(spark, d, "part").select("p_partkey", c.alias("confidence"))


@query("cls_quality_band", "SELECT CASE WHEN rating >= 4.25 THEN 'high' WHEN rating >= 3.25 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM scraped_reviews WHERE rating IS NOT NULL GROUP BY 1")
def cls_quality_band(spark, d):
    b = F.when(F.col("rating") >= 4.25, "high").when(F.col("rating") >= 3.25, "medium").otherwise("low")
    return table(spark, d, "scraped_reviews").where("rating IS NOT NULL").groupBy(b.alias("band")).agg(F.count("*").alias("n"))


@query("prj_truncate_ellipsis", "SELECT doc_id, CASE WHEN length(trim(text)) > 160 THEN substr(trim(text), 1, 159) || '…' ELSE trim(text) END AS preview, CAST(length(trim(text)) > 160 AS INT) AS is_truncated FROM documents")
def prj_truncate_ellipsis(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.ellipsis(F.col("text"), 160).alias("preview"), (F.length(F.trim("text")) > 160).cast("int").alias("is_truncated"))


@query("prj_enum_label", ONLY + " SELECT CASE priority WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' WHEN 0 THEN 'Info' ELSE 'Unknown' END AS label, count(*) AS n FROM cl GROUP BY 1")
def prj_enum_label(spark, d):
    names = F.create_map(*[x for k, v in domain.PRIORITIES.items() for x in (F.lit(k), F.lit(v))])
    return domain.clauses(spark, d).groupBy(F.coalesce(F.element_at(names, F.col("priority")), F.lit("Unknown")).alias("label")).agg(F.count("*").alias("n"))


@query("prj_rating_parse", "SELECT row_id, CASE WHEN rating IS NULL THEN 3 ELSE CAST(least(greatest(round_even(rating, 0), 1), 5) AS INT) END AS rating FROM scraped_reviews")
def prj_rating_parse(spark, d):
    return table(spark, d, "scraped_reviews").select("row_id", tx.rating_int(F.col("rating").cast("string")).alias("rating"))


@query("prj_rating_half_up", "SELECT row_id, CASE WHEN rating IS NOT NULL THEN CAST(least(greatest(floor(rating + 0.5), 1), 5) AS INT) END AS rating FROM scraped_reviews")
def prj_rating_half_up(spark, d):
    return table(spark, d, "scraped_reviews").select("row_id", tx.rating_half_up(F.col("rating").cast("string")).alias("rating"))


@query("prj_rating_0_5", "SELECT row_id, CASE WHEN rating IS NOT NULL THEN least(greatest(CASE WHEN rating > 5 THEN rating / 2 ELSE rating END, 0), 5) END AS rating FROM scraped_reviews")
def prj_rating_0_5(spark, d):
    r = F.when(F.col("rating") > 5, F.col("rating") / 2).otherwise(F.col("rating"))
    # least and greatest skip NULLs in both engines, so a missing rating is guarded
    return table(spark, d, "scraped_reviews").select("row_id", F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(0.0)), F.lit(5.0))).alias("rating"))


@query("prj_rating_int15", "SELECT row_id, CASE WHEN trunc(rating) BETWEEN 1 AND 5 THEN CAST(trunc(rating) AS INT) END AS rating FROM scraped_reviews")
def prj_rating_int15(spark, d):
    i = F.col("rating").cast("int")
    return table(spark, d, "scraped_reviews").select("row_id", F.when(i.between(1, 5), i).alias("rating"))


@query("prj_age", "SELECT o_orderkey, CAST(date_diff('year', o_orderdate, TIMESTAMP '2024-03-15') - CASE WHEN strftime(o_orderdate, '%m%d') > '0315' THEN 1 ELSE 0 END AS INT) AS age FROM orders")
def prj_age(spark, d):
    y = F.lit(2024) - F.year("o_orderdate") - F.when(F.date_format("o_orderdate", "MMdd") > "0315", 1).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", F.when(y >= 0, y).cast("int").alias("age"))


@query("prj_canonical_category", "SELECT department, CASE WHEN department IN ('technical', 'housekeeping') THEN department WHEN contains(department, 'front') THEN 'front_office' WHEN contains(department, 'food') THEN 'food_beverage' ELSE 'Diğer' END AS category, count(*) AS n FROM entity_comments GROUP BY 1, 2")
def prj_canonical_category(spark, d):
    c = F.col("department")
    cat = F.coalesce(F.when(c.isin("technical", "housekeeping"), c), F.when(F.contains(c, F.lit("front")), F.lit("front_office")), F.when(F.contains(c, F.lit("food")), F.lit("food_beverage")), F.lit("Diğer"))
    return table(spark, d, "entity_comments").groupBy(c, cat.alias("category")).agg(F.count("*").alias("n"))


@query("prj_platform_alias", "SELECT platform, CASE WHEN p IN ('ta') THEN 'tripadvisor' WHEN p = 'csv' THEN 'csv_import' ELSE p END AS canonical, count(*) AS n FROM (SELECT platform, regexp_replace(lower(trim(platform)), '\\.(com|net|org|de)$', '') AS p FROM scraped_reviews) GROUP BY 1, 2")
def prj_platform_alias(spark, d):
    from guestlens.operators.timestamps import canonical_platform

    return table(spark, d, "scraped_reviews").groupBy("platform").agg(F.count("*").alias("n")).withColumn("canonical", canonical_platform(F.col("platform")))


@query("dt_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_key, strftime(ts, '%Y') || '-W' || strftime(ts, '%V') AS week_key, strftime(ts, '%Y-%m') AS month_key FROM events")
def dt_keys(spark, d):
    week = F.concat(F.year("ts").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))  # calendar year with ISO week
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day_key"), week.alias("week_key"), F.date_format("ts", "yyyy-MM").alias("month_key"))


@query("dt_local_day", "SELECT event_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS day FROM events")
def dt_local_day(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Istanbul"), F.col("ts"))).alias("day"))


@query("dt_time_window_phrase", "SELECT event_id, CASE WHEN ts >= date_trunc('week', TIMESTAMP '2024-01-24') AND ts < date_trunc('week', TIMESTAMP '2024-01-24') + INTERVAL 7 DAY THEN 'this week' WHEN ts >= date_trunc('week', TIMESTAMP '2024-01-24') - INTERVAL 7 DAY AND ts < date_trunc('week', TIMESTAMP '2024-01-24') THEN 'last week' ELSE 'other' END AS phrase FROM events")
def dt_time_window_phrase(spark, d):
    start = F.date_trunc("week", F.lit("2024-01-24").cast("timestamp_ntz"))
    t = F.col("ts")
    p = F.when((t >= start) & (t < start + F.expr("INTERVAL 7 DAYS")), "this week").when((t >= start - F.expr("INTERVAL 7 DAYS")) & (t < start), "last week").otherwise("other")
    return table(spark, d, "events").select("event_id", p.alias("phrase"))


@query("dt_parse_iso", "SELECT id, epoch_us(try_cast(replace(created_at, 'Z', '+00:00') AS TIMESTAMPTZ)) AS micros FROM entity_comments")
def dt_parse_iso(spark, d):
    return table(spark, d, "entity_comments").select("id", F.unix_micros(F.try_to_timestamp(F.regexp_replace("created_at", "Z$", "+00:00"))).alias("micros"))


@query("mth_backoff", "SELECT user_id, least(60, 3 * pow(2, n)) AS seconds FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1)")
def mth_backoff(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return g.select("user_id", F.least(F.lit(60.0), 3 * F.pow(F.lit(2.0), F.col("n"))).alias("seconds"))


@query("mth_clamp", "SELECT event_id, greatest(-1, least(1, (value - 50) / 25)) AS score FROM events")
def mth_clamp(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 25)).alias("score"))


@query("mth_round_bankers", "SELECT event_id, round_even(value, 1) AS r1, round_even(value, 0) AS r0 FROM events")
def mth_round_bankers(spark, d):
    return table(spark, d, "events").select("event_id", F.bround("value", 1).alias("r1"), F.bround("value", 0).alias("r0"))


@query("mth_softmax_conf", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT *, exp(n / 10.0 - max(n / 10.0) OVER (PARTITION BY p_brand)) AS e FROM c) SELECT p_brand, p_type, round_even(e / sum(e) OVER (PARTITION BY p_brand), 6) AS confidence FROM m")
def mth_softmax_conf(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg((F.count("*") / 10.0).alias("s"))
    w = W.partitionBy("p_brand")
    e = c.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("p_brand", "p_type", F.bround(F.col("e") / F.sum("e").over(w), 6).alias("confidence"))


@query("arr_distinct_ordered", D + "w AS (SELECT review_id, word, min((clause_index, category_id, reviewer_id, price)) AS f FROM (SELECT review_id, clause_index, category_id, reviewer_id, price, aspect AS word FROM cl) GROUP BY 1, 2) SELECT review_id, string_agg(word, '|' ORDER BY f) AS aspects FROM w GROUP BY 1")
def arr_distinct_ordered(spark, d):
    g = domain.clauses(spark, d).groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("clause_index", "category_id", "reviewer_id", "price", "aspect"))).alias("a"))
    return g.select("review_id", F.array_join(F.array_distinct(F.transform("a", lambda x: x["aspect"])), "|").alias("aspects"))


@query("map_counter_zero_fill", ONLY + ", s AS (SELECT unnest(['Positive', 'Negative', 'Neutral', 'Mixed']) AS sentiment) SELECT s.sentiment, count(cl.review_id) AS n FROM s LEFT JOIN cl USING (sentiment) GROUP BY 1")
def map_counter_zero_fill(spark, d):
    names = ("Positive", "Negative", "Neutral", "Mixed")
    one = domain.clauses(spark, d).agg(*[F.count_if(F.col("sentiment") == n).alias(n) for n in names])
    return one.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("sentiment", "n"))


@query("jsn_parse_defaults", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), 0) AS k, coalesce(json_extract_string(props, '$.label'), 'none') AS label FROM events")
def jsn_parse_defaults(spark, d):
    j = F.from_json("props", "k int, label string")
    return table(spark, d, "events").select("event_id", F.coalesce(j["k"], F.lit(0)).alias("k"), F.coalesce(j["label"], F.lit("none")).alias("label"))


@query("jsn_build", "SELECT id, '{\"id\":\"' || id || '\",\"rating\":' || CAST(CAST(rating AS INT) AS VARCHAR) || '}' AS doc FROM platform_reviews WHERE rating IS NOT NULL")
def jsn_build(spark, d):
    return table(spark, d, "platform_reviews").where("rating IS NOT NULL").select("id", F.to_json(F.struct("id", F.col("rating").cast("int").alias("rating"))).alias("doc"))


@query("jsn_array_update", "SELECT p_partkey, '[\"' || p_type || '\",\"' || p_brand || '\"]' AS arr FROM part")
def jsn_array_update(spark, d):
    old = F.from_json(F.to_json(F.array("p_type")), "array<string>")
    return table(spark, d, "part").select("p_partkey", F.to_json(F.concat(old, F.array("p_brand"))).alias("arr"))


@query("hsh_ids", "SELECT id, substr(sha256(id), 1, 16) AS a, substr(sha1(id), 1, 12) AS b, substr(md5(id), 1, 12) AS c FROM reviews")
def hsh_ids(spark, d):
    return table(spark, d, "reviews").select("id", F.substring(F.sha2("id", 256), 1, 16).alias("a"), F.substring(F.sha1("id"), 1, 12).alias("b"), F.substring(F.md5("id"), 1, 12).alias("c"))


@query("srt_case_priority", "SELECT id FROM platform_reviews ORDER BY CASE WHEN language IN ('tr', 'az', 'tk') THEN 0 ELSE 1 END, id LIMIT 25")
def srt_case_priority(spark, d):
    return table(spark, d, "platform_reviews").orderBy(F.when(F.col("language").isin("tr", "az", "tk"), 0).otherwise(1), "id").limit(25).select("id")


@query("srt_canonical_order", "SELECT department, CAST(CASE department WHEN 'technical' THEN 1 WHEN 'housekeeping' THEN 2 WHEN 'front_office' THEN 3 ELSE 99 END AS INT) AS place FROM (SELECT DISTINCT department FROM entity_comments)")
def srt_canonical_order(spark, d):
    order = F.array(*map(F.lit, ("technical", "housekeeping", "front_office")))
    p = F.array_position(order, F.col("department"))
    return table(spark, d, "entity_comments").select("department").distinct().select("department", F.when(F.coalesce(p, F.lit(0)) > 0, p).otherwise(99).cast("int").alias("place"))


@query("srt_last_n_reversed", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20")
def srt_last_n_reversed(spark, d):
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(20).select("event_id")


@query("srt_split_active_past", "SELECT id, CAST(status = 'completed' AS INT) AS past FROM (SELECT DISTINCT * FROM review_assignments) ORDER BY coalesce(completed_at, assigned_at) DESC, id LIMIT 40")
def srt_split_active_past(spark, d):
    a = table(spark, d, "review_assignments").distinct()
    return a.orderBy(F.desc(F.coalesce("completed_at", "assigned_at")), "id").limit(40).select("id", (F.col("status") == "completed").cast("int").alias("past"))


@query("srt_role_rank", "SELECT username FROM users ORDER BY CASE role WHEN 'admin' THEN 0 ELSE 1 END, display_name, username LIMIT 15")
def srt_role_rank(spark, d):
    return table(spark, d, "users").orderBy(F.when(F.col("role") == "admin", 0).otherwise(1), "display_name", "username").limit(15).select("username")


@query("srt_priority_aspects", ONLY + " SELECT review_id, clause_index FROM cl ORDER BY priority DESC, CAST(sentiment = 'Negative' AS INT), abs(score5) DESC, review_id, clause_index, category_id, reviewer_id, price LIMIT 30")
def srt_priority_aspects(spark, d):
    c = domain.clauses(spark, d)
    return c.orderBy(F.desc("priority"), (F.col("sentiment") == "Negative").cast("int"), F.desc(F.abs("score5")), "review_id", "clause_index", "category_id", "reviewer_id", "price").limit(30).select("review_id", "clause_index")


@query("srt_prio_sample", "SELECT doc_id FROM documents ORDER BY CASE WHEN lang IS NULL THEN 2 ELSE 0 END + CASE WHEN n_chars < 100 THEN 1 ELSE 0 END DESC, doc_id LIMIT 30")
def srt_prio_sample(spark, d):
    score = F.when(F.col("lang").isNull(), 2).otherwise(0) + F.when(F.col("n_chars") < 100, 1).otherwise(0)
    return table(spark, d, "documents").orderBy(F.desc(score), "doc_id").limit(30).select("doc_id")


@query("srt_seeded_sample", "SELECT id FROM reviews ORDER BY md5(id || ':42'), id LIMIT 400")
def srt_seeded_sample(spark, d):
    """A repeatable sample of 400: the rows of smallest seeded hash."""
    return table(spark, d, "reviews").orderBy(F.md5(F.concat("id", F.lit(":42"))), "id").limit(400).select("id")
