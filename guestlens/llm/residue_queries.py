"""Queries for problem 10: template residue and error-page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from guestlens.llm import residue
from guestlens.llm.registry import query
from guestlens.sources.tables import table


@query("p10_scored")
def p10_scored(spark: SparkSession, d: str) -> DataFrame:
    """Every document's share and kind of residue, its first placeholder, and whether it goes."""
    docs = table(spark, d, "documents")
    return residue.classify(docs, residue.fitted(docs))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scored(spark, d).where("excluded").select("doc_id")


@query("p10_kept")
def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that remain."""
    return table(spark, d, "documents").join(p10_found(spark, d), "doc_id", "left_anti")
