"""Queries of the file formats: workbooks, databases, pages, rule files, and the adapters that tell them apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.registry import query
from guestlens.rulesets import hotel
from guestlens.session import scratch_path
from guestlens.sources import contents
from guestlens.sources.tables import table


@query("src_excel_magic", "SELECT CAST(hotel_id AS VARCHAR) AS review_id, name AS guest_name FROM hotels")
def src_excel_magic(spark, d):
    """Files of one delivery, workbooks and delimited text alike, told apart by their first bytes."""
    h = table(spark, d, "hotels").select(F.col("hotel_id").alias("id"), "name")
    files = contents.written(h.where("hotel_id % 2 = 0"), "xlsx", "id").unionByName(contents.written(h.where("hotel_id % 2 = 1"), "csv", "id"))
    return contents.read(files).select("review_id", "guest_name")


@query("src_excel_pandas", "SELECT id AS review_id, comment, CAST(rating AS DOUBLE) AS rating FROM reviews WHERE comment IS NOT NULL AND comment <> ''")
def src_excel_pandas(spark, d):
    """A workbook read under its header's aliases, numbers typed."""
    r = table(spark, d, "reviews").where("comment IS NOT NULL AND comment <> ''").select(F.col("id").alias("Yorum ID"), F.col("comment").alias("Yorum Metni"), F.col("rating").alias("Puan"))
    return contents.read(contents.written(r, "xlsx", "Yorum ID"), "xlsx").select("review_id", "comment", F.col("rating").cast("double").alias("rating"))


@query("snk_xlsx", "SELECT id AS review_id, hotel_name AS guest_name FROM reviews WHERE rating = 5")
def snk_xlsx(spark, d):
    """Workbooks of bounded size, kept as a table of files and read again."""
    path = scratch_path(spark, "workbooks")
    r = table(spark, d, "reviews").where("rating = 5").select("id", F.col("hotel_name").alias("name"))
    contents.written(r, "xlsx", "id", rows_per_file=20_000).write.parquet(path)
    return contents.read(spark.read.parquet(path)).select("review_id", "guest_name")


@query("src_sqlite", "SELECT id AS review_id, review_text AS comment FROM platform_reviews WHERE rating >= 4")
def src_sqlite(spark, d):
    """A statement on SQLite files, run where each file lies."""
    p = table(spark, d, "platform_reviews").select("id", "review_text", "rating")
    return contents.read(contents.written(p, "sqlite", "id"), "sqlite", "SELECT id, review_text AS comment FROM rows WHERE rating >= 4").select("review_id", "comment")


@query("src_html_maps", "SELECT id AS review_id, coalesce(comment, '') AS comment, coalesce(guest_name, '') AS guest_name FROM reviews")
def src_html_maps(spark, d):
    r = table(spark, d, "reviews").select("id", "comment", F.col("guest_name").alias("author"), "rating")
    return contents.read(contents.written(r, "maps", "id"), "maps").select("review_id", "comment", "guest_name")


@query("src_html_jsonld", "SELECT id AS review_id, review_text AS comment, CAST(rating AS DOUBLE) AS rating FROM platform_reviews")
def src_html_jsonld(spark, d):
    p = table(spark, d, "platform_reviews").select("id", F.col("review_text").alias("comment"), "rating")
    return contents.read(contents.written(p, "jsonld", "id"), "jsonld").select("review_id", "comment", F.col("rating").cast("double").alias("rating"))


@query("src_adapter_registry", "SELECT id AS review_id, comment FROM reviews WHERE comment <> '' AND NOT regexp_matches(comment, '\\n|^\\s|\\s$')")
def src_adapter_registry(spark, d):
    """One delivery of eight formats, each file recognised; pasted text can't hold comments of several lines."""
    r = table(spark, d, "reviews").where("comment <> '' AND NOT regexp_like(comment, '\\\\n|^\\\\s|\\\\s$')").select("id", "comment")
    part = F.pmod(F.xxhash64("id"), F.lit(len(contents.ADAPTERS)))
    files = reduce(DataFrame.unionByName, [contents.written(r.where(part == i), kind, "id").withColumn("path", F.concat(F.lit(kind + "/"), "path")) for i, kind in enumerate(sorted(contents.ADAPTERS))])
    return contents.read(files).select("review_id", "comment")


BASE_RULES = {**hotel.POSITIVE, **{w: -x for w, x in hotel.NEGATIVE.items()}}
OVERRIDES = {"good": 1.2, "cold": -0.4, "pricey": -0.7, "awful": 3.0, "cosy": 0.9}
PROTECTED = ("awful", "berbat")
MERGED = {**BASE_RULES, **{k: v for k, v in OVERRIDES.items() if k not in PROTECTED}}


def rule_file(weights: dict[str, float], protected: tuple[str, ...] = ()) -> str:
    return "# weights of words\nweights:\n" + "".join(f"  {k}: {v}\n" for k, v in weights.items()) + "protected:\n" + "".join(f"  - {k}\n" for k in protected)


def parsed_rules(files: DataFrame) -> DataFrame:
    """weights (map) and protected (array) of rule files in the block style of YAML: sections, `key: number` and `- item` lines."""
    line = lambda pattern: F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    keys, numbers = line(r"(?m)^  ([^:\s#][^:\n]*): +-?[0-9.]+ *$"), line(r"(?m)^  [^:\s#][^:\n]*: +(-?[0-9.]+) *$")
    return files.select(F.map_from_arrays(keys, F.transform(numbers, lambda x: x.cast("double"))).alias("weights"), line(r"(?m)^  - +(.+?) *$").alias("protected"))


@query("src_yaml_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in MERGED.items()) + ") t(rule, weight)")
def src_yaml_rules(spark, d):
    """Two rule files from the shared folder, the second over the first but for what the first protects."""
    path = scratch_path(spark, "rules")
    for name, text in (("base", rule_file(BASE_RULES, PROTECTED)), ("extra", rule_file(OVERRIDES))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    base, extra = (parsed_rules(spark.read.text(f"{path}/{n}", wholetext=True)).withColumn("no", F.lit(i)) for i, n in enumerate(("base", "extra")))
    both = base.unionByName(extra).agg(F.min_by("weights", "no").alias("weights"), F.min_by("protected", "no").alias("protected"), F.max_by("weights", "no").alias("over"))
    both = both.select("weights", F.map_filter("over", lambda k, v: ~F.array_contains("protected", k)).alias("over"))
    merged = F.map_concat(F.map_filter("weights", lambda k, v: ~F.map_contains_key("over", k)), "over")
    return both.select(F.explode(merged).alias("rule", "weight"))


@query("map_merge_protected", "SELECT hotel_id, u.k AS key, u.v AS value FROM (SELECT hotel_id, unnest([{'k': 'code', 'v': code}, {'k': 'city', 'v': upper(city)}, {'k': 'country', 'v': country}, {'k': 'zone', 'v': time_zone}]) AS u FROM hotels)")
def map_merge_protected(spark, d):
    """A row's own map under an override map, but for protected keys."""
    base = F.create_map(F.lit("code"), "code", F.lit("city"), "city", F.lit("country"), "country")
    over = F.create_map(F.lit("city"), F.upper("city"), F.lit("code"), F.lit("?"), F.lit("zone"), "time_zone")
    h = table(spark, d, "hotels").select("hotel_id", base.alias("base"), F.map_filter(over, lambda k, v: ~k.isin("code")).alias("over"))
    return h.select("hotel_id", F.explode(F.map_concat(F.map_filter("base", lambda k, v: ~F.map_contains_key("over", k)), "over")).alias("key", "value"))
