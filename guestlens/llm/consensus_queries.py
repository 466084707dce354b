"""Queries for problem 2: consensus from several annotators' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from guestlens.llm import consensus
from guestlens.llm.registry import query
from guestlens.sources.tables import table


def _fitted(spark: SparkSession, d: str):
    items = consensus.prepared(table(spark, d, "absa_corrections"), table(spark, d, "review_assignments"))
    names, alpha, _ = consensus.fit(spark, items)
    return items, names, alpha


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_consensus(spark, d).select("review_id", "field_name", "label")


@query("p2_consensus")
def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(*_fitted(spark, d))


@query("p2_annotators")
def p2_annotators(spark: SparkSession, d: str) -> DataFrame:
    items, names, alpha = _fitted(spark, d)
    return consensus.reliabilities(spark, items, consensus.consensus(items, names, alpha), names, alpha)


@query(
    "p2_agreement",
    sql="""
    WITH l AS (SELECT review_id, field_name, user_id,
                 arg_max(regexp_replace(lower(translate(trim(corrected_value), 'İIıöÖ', 'iiioo')), '[ \\-_]+', '_', 'g'), struct_pack(a := created_at, b := id)) AS label
               FROM absa_corrections WHERE field_name IN ('ana_departman', 'genel_duygu') AND corrected_value IS NOT NULL AND user_id IS NOT NULL AND review_id IS NOT NULL
               GROUP BY ALL),
    i AS (SELECT *, count(*) OVER (PARTITION BY review_id, field_name) AS m FROM l),
    p AS (SELECT review_id, field_name, m, label, count(*) AS c FROM i WHERE m >= 3 GROUP BY ALL),
    o AS (SELECT field_name, sum(c * (m - c) / (m - 1)) AS d, sum(c) AS n FROM p GROUP BY 1),
    t AS (SELECT field_name, label, sum(c) AS t FROM p GROUP BY 1, 2),
    e AS (SELECT field_name, sum(t * (n - t) / (n - 1)) AS e FROM t JOIN o USING (field_name) GROUP BY 1)
    SELECT field_name, CAST(n AS BIGINT) AS labels, round(1 - d / e, 6) AS alpha FROM o JOIN e USING (field_name)
    """,
)
def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    return consensus.krippendorff(consensus.prepared(table(spark, d, "absa_corrections"))).withColumn("alpha", F.round("alpha", 6))
