"""Retrieval and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from guestlens.operators import retrieval as rt
from guestlens.registry import query
from guestlens.session import scratch_path
from guestlens.sources.tables import table

WORDS = "w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS term FROM part), tf AS (SELECT p_partkey, term, count(*) AS tf FROM w GROUP BY 1, 2), idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM part)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1), raw AS (SELECT p_partkey, term, tf * idf AS w FROM tf JOIN idf USING (term)), tw AS (SELECT p_partkey, term, w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)) AS w FROM raw)"


def weights(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    return rt.term_weights(table(spark, d, "part"), "p_partkey", words)


@query("ret_cosine_topk", f"WITH {WORDS}, q AS (SELECT p_partkey AS q, term, w AS wq FROM tw WHERE p_partkey % 50 = 0), s AS (SELECT q, p_partkey, sum(w * wq) AS score FROM q JOIN tw USING (term) WHERE q <> p_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, p_partkey) AS rank FROM s) SELECT q, p_partkey, CAST(rank AS INT) AS rank, round_even(score, 6) AS score FROM r WHERE rank <= 5")
def ret_cosine_topk(spark, d):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    path = scratch_path(spark, "weights")
    weights(spark, d)[0].write.parquet(path)  # read for the queries and for the rows
    w = spark.read.parquet(path)
    r = rt.cosine_nearest(w, w.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("q"), "term", "w"), "p_partkey", "q", 5)
    return r.select("q", "p_partkey", "rank", F.bround("score", 6).alias("score"))


@query("ret_vector_ip", "WITH s AS (SELECT a.vec_id AS q, b.vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) SELECT q, vec_id, CAST(rank AS INT) AS rank, round_even(score, 6) AS score FROM r WHERE rank <= 3")
def ret_vector_ip(spark, d):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return rt.nearest(e, q, "vec_id", "q", "embedding", 3).select("q", "vec_id", "rank", F.bround("score", 6).alias("score"))


