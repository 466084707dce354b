"""Source and sink queries: files are written to the shared folder, read back and checked against the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from guestlens.operators import relational as rel
from guestlens.registry import query
from guestlens.session import scratch_path
from guestlens.sources import readers
from guestlens.sources.tables import table


@query("src_csv_delim_sniff", "SELECT name, city FROM hotels")
def src_csv_delim_sniff(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "hotels").select(F.col("name").alias("Hotel Name"), F.col("city").alias("CITY")).write.option("header", True).option("sep", ";").csv(path)
    return readers.read_delimited(spark, path).select(F.col("hotelname").alias("name"), "city")


@query("src_csv_alias", "SELECT id AS review_id, coalesce(comment, '') AS comment, coalesce(source, '') AS source FROM reviews")
def src_csv_alias(spark, d):
    path = scratch_path(spark, "csv")
    r = table(spark, d, "reviews").select(F.col("id").alias("Yorum ID"), F.col("comment").alias("Yorum Metni"), F.col("source").alias("Kaynak"))
    r.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.with_aliases(readers.read_delimited(spark, path)).select("review_id", "comment", "source")


@query("src_bom_csv", "SELECT name FROM hotels")
def src_bom_csv(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "hotels").select(F.col("name").alias(readers.BOM + "name")).write.option("header", True).csv(path)
    return readers.read_delimited(spark, path).select("name")


@query("src_csv_bulk", "SELECT id, comment AS text FROM reviews WHERE length(comment) >= 8 UNION ALL SELECT id, comment FROM entity_comments WHERE length(comment) >= 8")
def src_csv_bulk(spark, d):
    path = scratch_path(spark, "csv")
    for name, column in (("reviews", "review"), ("entity_comments", "content")):
        table(spark, d, name).select("id", F.col("comment").alias(column)).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{path}/{name}")
    a, b = (readers.read_delimited(spark, f"{path}/{n}") for n in ("reviews", "entity_comments"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select("id", F.coalesce("review", "content").alias("text")).where("length(text) >= 8")


@query("src_jsonl", "SELECT id, comment FROM reviews WHERE comment IS NOT NULL")
def src_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    good = table(spark, d, "reviews").where("comment IS NOT NULL").select(F.to_json(F.struct("id", "comment")).alias("value"))
    good.unionByName(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    return readers.read_json_lines(spark, path, "id string, comment string").select("id", "comment")


@query("src_jsonl_nested", "SELECT id, CASE WHEN department IS NULL THEN 'general' ELSE department END AS aspect, CASE WHEN department IS NULL THEN 1 ELSE 3 END AS weight FROM entity_comments")
def src_jsonl_nested(spark, d):
    path = scratch_path(spark, "jsonl")
    table(spark, d, "entity_comments").select("id", F.when(F.col("department").isNull(), F.array().cast("array<string>")).otherwise(F.array("department")).alias("aspects")).write.json(path)
    return readers.exploded_aspects(readers.read_json_lines(spark, path, "id string, aspects array<string>"), "id", "aspects")


@query("src_json_store", "SELECT hotel_id, code FROM hotels")
def src_json_store(spark, d):
    path = scratch_path(spark, "store")
    rows = table(spark, d, "hotels").agg(F.to_json(F.collect_list(F.struct("hotel_id", "code"))).alias("value"))  # a dimension, in one file as the store has it
    rows.write.text(path)
    return readers.read_json_store(spark, path, "hotel_id int, code string")


@query("src_csv_pos_neg_concat", "SELECT row_id, concat_ws('. ', CASE WHEN trim(positive_text) NOT IN ('', 'No Positive', 'No Negative') THEN trim(positive_text) END, CASE WHEN trim(negative_text) NOT IN ('', 'No Positive', 'No Negative') THEN trim(negative_text) END) AS text FROM scraped_reviews WHERE positive_text IS NOT NULL OR negative_text IS NOT NULL")
def src_csv_pos_neg_concat(spark, d):
    s = table(spark, d, "scraped_reviews").where("positive_text IS NOT NULL OR negative_text IS NOT NULL")
    return s.select("row_id", readers.positive_negative(F.col("positive_text"), F.col("negative_text")).alias("text"))


@query("src_paste_blocks", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda b: trim(b) <> '')) AS INT) AS blocks FROM documents WHERE text IS NOT NULL")
def src_paste_blocks(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(readers.paste_blocks(F.col("text"))).alias("blocks"))


HALF = "CAST(substr(md5(id), 1, 1) AS VARCHAR) < '8'"


def halves(spark, d):
    r = table(spark, d, "reviews").select("id", "rating", "language")
    first = F.substring(F.md5("id"), 1, 1) < "8"
    return r.where(first), r.where(~first | (F.col("rating") >= 4))


@query("snk_insert", "SELECT count(*) AS n FROM (SELECT id FROM reviews UNION ALL SELECT id FROM reviews WHERE rating = 5)")
def snk_insert(spark, d):
    path = scratch_path(spark, "insert")
    r = table(spark, d, "reviews").select("id", "rating")
    r.write.parquet(path)
    r.where("rating = 5").write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("snk_upsert_conflict_nothing", f"WITH a AS (SELECT id, rating FROM reviews WHERE {HALF}), b AS (SELECT id, -1.0 AS rating FROM reviews WHERE NOT ({HALF}) OR rating >= 4) SELECT id, CAST(rating AS DOUBLE) AS rating FROM a UNION ALL SELECT id, CAST(rating AS DOUBLE) FROM b WHERE id NOT IN (SELECT id FROM a)")
def snk_upsert_conflict_nothing(spark, d):
    a, b = halves(spark, d)
    return rel.insert_ignore(a.select("id", F.col("rating").cast("double").alias("rating")), b.select("id", F.lit(-1.0).alias("rating")), ["id"])


@query("snk_upsert_replace", f"WITH a AS (SELECT id, rating FROM reviews WHERE {HALF}), b AS (SELECT id, -1.0 AS rating FROM reviews WHERE NOT ({HALF}) OR rating >= 4) SELECT id, CAST(rating AS DOUBLE) AS rating FROM b UNION ALL SELECT id, CAST(rating AS DOUBLE) FROM a WHERE id NOT IN (SELECT id FROM b)")
def snk_upsert_replace(spark, d):
    a, b = halves(spark, d)
    return rel.upsert(a.select("id", F.col("rating").cast("double").alias("rating")), b.select("id", F.lit(-1.0).alias("rating")), ["id"])


@query("snk_upsert_count", "SELECT event_type AS key, CAST(ts AS DATE) AS day, max_by(event_id, event_id) AS count FROM events GROUP BY 1, 2")
def snk_upsert_count(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.to_date("ts").alias("day"), F.col("event_id").alias("count"))
    return rel.keep_last(e, ["key", "day"], ["count"])  # a later count replaces, it doesn't add


@query("snk_case_upsert", "SELECT entity_id, count(*) AS occurrences, string_agg(DISTINCT issue_type, ',' ORDER BY issue_type) AS kinds FROM entity_comments GROUP BY 1")
def snk_case_upsert(spark, d):
    return table(spark, d, "entity_comments").groupBy("entity_id").agg(F.count("*").alias("occurrences"), F.nullif(F.array_join(F.array_sort(F.collect_set("issue_type")), ","), F.lit("")).alias("kinds"))


@query("snk_soft_delete", "SELECT id, is_active AND NOT coalesce(rating <= 1, false) AS is_active FROM reviews")
def snk_soft_delete(spark, d):
    return table(spark, d, "reviews").select("id", (F.col("is_active") & ~F.coalesce(F.col("rating") <= 1, F.lit(False))).alias("is_active"))


@query("snk_hard_delete_before", "SELECT id FROM review_assignments WHERE NOT coalesce(status = 'completed' AND completed_at < '2025-01-01', false)")
def snk_hard_delete_before(spark, d):
    return table(spark, d, "review_assignments").where(~F.coalesce((F.col("status") == "completed") & (F.col("completed_at") < "2025-01-01"), F.lit(False))).select("id")


@query("snk_update_orphans", "SELECT e.id, CASE WHEN r.id IS NULL THEN NULL ELSE e.review_id END AS review_id FROM entity_comments e LEFT JOIN (SELECT id FROM reviews WHERE is_active) r ON r.id = e.review_id")
def snk_update_orphans(spark, d):
    e, r = table(spark, d, "entity_comments").select("id", "review_id"), table(spark, d, "reviews").where("is_active").select(F.col("id").alias("rid"))
    return e.join(r, e.review_id == r.rid, "left").select("id", F.when(F.col("rid").isNotNull(), F.col("review_id")).alias("review_id"))


@query("snk_csv_export", "SELECT id, hotel_name FROM reviews WHERE rating = 5")
def snk_csv_export(spark, d):
    path = scratch_path(spark, "export")
    table(spark, d, "reviews").where("rating = 5").select("id", "hotel_name").write.option("header", True).option("nullValue", "\\N").csv(path)
    return spark.read.schema("id string, hotel_name string").option("header", True).option("nullValue", "\\N").csv(path)


@query("snk_jsonl_append", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id FROM users UNION ALL SELECT id FROM users)")
def snk_jsonl_append(spark, d):
    path = scratch_path(spark, "log")
    for _ in range(2):
        table(spark, d, "users").select("id", "role").write.mode("append").json(path)
    return spark.read.schema("id string, role string").json(path).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("snk_resume_batch", f"SELECT id FROM reviews WHERE NOT ({HALF})")
def snk_resume_batch(spark, d):
    path = scratch_path(spark, "resume")
    r = table(spark, d, "reviews").select("id")
    r.where(F.substring(F.md5("id"), 1, 1) < "8").write.parquet(path)  # what an earlier run got done
    return r.join(spark.read.parquet(path), "id", "left_anti")


@query("snk_audit_interceptor", f"WITH o AS (SELECT id, rating FROM reviews WHERE {HALF}), n AS (SELECT id, CASE WHEN rating = 3 THEN 4 ELSE rating END AS rating FROM reviews WHERE NOT ({HALF}) OR rating >= 3) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'CREATE' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.rating IS DISTINCT FROM n.rating")
def snk_audit_interceptor(spark, d):
    r = table(spark, d, "reviews").select("id", F.col("rating").cast("double").alias("rating"))
    first = F.substring(F.md5("id"), 1, 1) < "8"
    new = r.where(~first | (F.col("rating") >= 3)).withColumn("rating", F.when(F.col("rating") == 3, 4.0).otherwise(F.col("rating")))
    return rel.audit_diff(r.where(first), new, "id", ["rating"])
