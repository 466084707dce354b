"""The review domain over the star-schema tables: reviews, clauses, action items, assignments, jobs.

Each relation has a DataFrame form and a SQL form (DOMAIN_SQL) that name the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.sources.tables import table

# Labels that name no particular topic (compared without case).
GENERIC_LABELS = ("standard", "general", "other")
PRIORITIES = {3: "Critical", 2: "High", 1: "Medium", 0: "Info"}
POSITIVE, NEGATIVE = 0.15, -0.15  # review bucket thresholds on the mean clause score


def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """The reviews without their hotel: no join. Every review has a guest (foreign key), so these are the same rows."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_orderdate").alias("review_date"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("rating"), F.col("o_orderstatus").alias("source"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("review_id"), F.col("c_nationkey").alias("hotel_id"), F.col("o_orderdate").alias("review_date"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("rating"), F.col("o_orderstatus").alias("source")
    )


def scored_clauses(spark: SparkSession, d: str) -> DataFrame:
    """review_id and score5 of the clauses, without their category: no join. Every clause has a category (foreign key)."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), (5 - F.round(F.col("l_discount") * 100).cast("int")).alias("score5"))


def clauses(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    s5 = 5 - F.round(F.col("l_discount") * 100).cast("int")
    q = F.col("l_quantity")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").alias("clause_index"), F.col("l_partkey").alias("category_id"), F.col("l_suppkey").alias("reviewer_id"), s5.alias("score5"),
        F.when(s5 >= 1, "Positive").when(s5 <= -1, "Negative").otherwise("Neutral").alias("sentiment"), F.when(q >= 38, 3).when(q >= 25, 2).when(q >= 13, 1).otherwise(0).alias("priority"),
        F.col("p_type").alias("aspect"), F.col("p_brand").alias("department"), F.col("p_name").alias("text"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("clause_date"),
    )


DOMAIN_SQL = """
WITH rv AS (SELECT o_orderkey AS review_id, c_nationkey AS hotel_id, o_orderdate AS review_date, CAST(o_orderkey % 5 + 1 AS INT) AS rating, o_orderstatus AS source
            FROM orders JOIN customer ON o_custkey = c_custkey),
cl AS (SELECT l_orderkey AS review_id, l_linenumber AS clause_index, l_partkey AS category_id, l_suppkey AS reviewer_id, CAST(5 - round(l_discount * 100) AS INT) AS score5,
         CASE WHEN 5 - round(l_discount * 100) >= 1 THEN 'Positive' WHEN 5 - round(l_discount * 100) <= -1 THEN 'Negative' ELSE 'Neutral' END AS sentiment,
         CASE WHEN l_quantity >= 38 THEN 3 WHEN l_quantity >= 25 THEN 2 WHEN l_quantity >= 13 THEN 1 ELSE 0 END AS priority,
         p_type AS aspect, p_brand AS department, p_name AS text, l_extendedprice AS price, l_shipdate AS clause_date
       FROM lineitem JOIN part ON l_partkey = p_partkey),
av AS (SELECT review_id, sum(score5) AS s, count(*) AS n FROM cl GROUP BY 1),
"""
