"""Readers for delivered files: delimited text with unknown delimiter and header names, JSON lines, pasted text, HTML.

Reading is distributed; only one line of a file (its header) is looked at on the driver.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header spellings of the standard fields.
ALIASES = {
    "guest_name": ("guestname", "author", "kullanıcıadı", "name", "user"),
    "comment": ("comment", "text", "review", "yorummetni", "yorum", "reviewtext", "content"),
    "rating": ("rating", "score", "stars", "puan", "puan(yıldız)"),
    "review_date": ("reviewdate", "date", "tarih", "tarih(metin)", "createdat"),
    "review_id": ("reviewid", "id", "yorumid"),
    "source": ("source", "platform", "kaynak"),
    "language": ("language", "lang", "dil"),
    "hotel_name": ("hotelname", "hotel", "otel"),
}
BOM = "﻿"


def header_key(name: str) -> str:
    return re.sub(r"[\s_]", "", name.replace(BOM, "").replace("İ", "i").lower())


def sniff_delimiter(line: str) -> str:
    """`;`, then tab, then comma: the first that the header holds."""
    return next((s for s in (";", "\t") if s in line), ",")


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).limit(1).first()
    return row[0].replace(BOM, "") if row else ""


def quotes_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes: only then must files be read whole, else they are split."""
    return bool(spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).limit(1).count())


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under normalised header names; quotes and line breaks inside fields are kept."""
    head = first_line(spark, path)
    sep = sniff_delimiter(head)
    names = [header_key(h) for h in next(csv.reader(io.StringIO(head), delimiter=sep), [])]
    if not names:
        return spark.createDataFrame([], "comment string")
    schema = ", ".join(f"`{n or f'c{i}'}` string" for i, n in enumerate(names))
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", quotes_span_lines(spark, path)).option("escape", '"').option("enforceSchema", True).csv(path)


def with_aliases(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """The standard fields, from a given mapping or by header alias; fields that are missing are ''."""
    have = {header_key(c): c for c in df.columns}
    chosen = []
    for field, names in ALIASES.items():
        column = (mapping or {}).get(field) or next((have[n] for n in (header_key(field), *names) if n in have), None)
        chosen.append((F.coalesce(F.col(f"`{column}`"), F.lit("")) if column else F.lit("")).alias(field))
    return df.select(*chosen)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of the schema; broken lines are left out."""
    df = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt IS NULL").drop("_corrupt")


def read_json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exploded_aspects(df: DataFrame, key: str, aspects: str) -> DataFrame:
    """One row per aspect with weight 3, or one row of weight 1 where there is none."""
    x = F.explode_outer(aspects)
    return df.select(key, x.alias("aspect")).withColumn("weight", F.when(F.col("aspect").isNull(), 1).otherwise(3)).withColumn("aspect", F.coalesce("aspect", F.lit("general")))


def paste_blocks(text: Column) -> Column:
    """Blocks between blank lines."""
    return F.filter(F.split(text, r"\n\s*\n"), lambda b: F.trim(b) != "")


def json_ld_reviews(html: DataFrame, key: str, column: str) -> DataFrame:
    """Review bodies and ratings in the page's JSON-LD blocks; pages without one give no row."""
    blocks = F.regexp_extract_all(column, F.lit(r'(?s)<script[^>]*ld\+json[^>]*>(.*?)</script>'), 1)
    schema = "review array<struct<reviewBody:string, reviewRating:struct<ratingValue:string>>>"
    r = html.select(key, F.explode(blocks).alias("b")).select(key, F.explode(F.from_json("b", schema)["review"]).alias("r"))
    return r.select(key, F.col("r.reviewBody").alias("comment"), F.col("r.reviewRating.ratingValue").try_cast("double").alias("rating"))


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags out."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def positive_negative(positive: Column, negative: Column) -> Column:
    """Both halves of a review as one text; the sentinels for an empty half are dropped."""
    clean = lambda c: F.when(F.trim(c).isin("", "No Positive", "No Negative"), F.lit(None)).otherwise(F.trim(c))
    return F.concat_ws(". ", clean(positive), clean(negative))
