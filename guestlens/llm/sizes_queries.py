"""Queries for problems 8 and 9: containers and mixes of documents measured in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.llm import mixing, packing, tokens
from guestlens.llm.registry import query
from guestlens.session import scratch_path
from guestlens.sources.tables import table


def sized(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, n_tokens, written once: the texts are tokenised one time only."""
    path = scratch_path(spark, "sizes")
    tokens.with_sizes(table(spark, d, "documents").select("doc_id", "source", "text")).write.parquet(path)
    return spark.read.parquet(path)


@query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place: for each capacity of pack_limits alone, and for all of them together (plan `joint`)."""
    docs = sized(spark, d)
    limits = {r.pack_name: [r.capacity_tokens] for r in table(spark, d, "pack_limits").collect()}  # a dimension of a few rows
    plans = limits | {"joint": sorted(c for cs in limits.values() for c in cs)}
    return packing.packed(docs, plans, groups=max(1, -(-docs.count() // packing.GROUP_ITEMS)))


@query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each plan and capacity are."""
    bins = p8_containers(spark, d).groupBy("plan", "container", "capacity").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return bins.groupBy("plan", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), (F.sum("used") / F.sum("capacity")).alias("fill"), F.sum(F.col("capacity") + F.col("capacity") * F.col("capacity") / packing.COST_LENGTH).alias("cost"))


@query("p9_mixed")
def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(sized(spark, d), table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixed(spark, d), table(spark, d, "mix_targets"))
