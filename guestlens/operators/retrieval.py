"""TF-IDF weights, and exact nearest rows of stated queries by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def term_weights(docs: DataFrame, key: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """(key, term, w) with smoothed idf ln((1 + n) / (1 + df)) + 1 and L2 norm, and the idf table."""
    tf = docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.count()
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1)
    raw = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w")), idf


QUERY_BLOCK = 2_048  # queries whose vectors a task holds at once


def best_of(scores: np.ndarray, keys: np.ndarray, k: int, kept: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, key) of each query's row, with what was kept before; ties by key."""
    keys = np.broadcast_to(keys, scores.shape)
    if kept is not None:
        scores, keys = np.concatenate([kept[0], scores], axis=1), np.concatenate([kept[1], keys], axis=1)
    if scores.shape[1] > k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        width = int((scores >= edge).sum(1).max())  # ties at the edge stay until they are ordered
        part = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
        scores, keys = np.take_along_axis(scores, part, 1), np.take_along_axis(keys, part, 1)
    order = np.lexsort((keys, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)


def merged(parts: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Ranks from 1 over the k best of every task."""
    top = parts.groupBy(query).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), key))), 1, k).alias("b"))  # k rows a task
    return top.select(query, F.posexplode("b").alias("rank", "x")).select(query, (F.col("rank") + 1).alias("rank"), F.col(f"x.{key}").alias(key), (-F.col("x.n")).alias("score"))


def blocks(queries: DataFrame, query: str, size: int | None = None) -> Iterator[list[Row]]:
    """The stated queries in blocks of about `size`, one on the driver at a time."""
    n = -(-queries.count() // (size or QUERY_BLOCK))
    for i in range(n):
        if rows := queries.where(F.pmod(F.xxhash64(query), F.lit(n)) == i).collect():
            yield rows


def nearest(vectors: DataFrame, queries: DataFrame, key: str, query: str, vector: str, k: int, block: int | None = None) -> DataFrame:
    """Exact top-k by inner product of stated queries against all vectors, themselves left out.

    A block of queries goes out as a matrix; each task multiplies its Arrow batches with it and hands on its k best per
    query. NULL vectors are left out; ties go to the lesser key.
    """
    schema = f"{query} bigint, {key} bigint, score double"
    out = None
    for rows in blocks(queries.where(F.col(vector).isNotNull()).select(query, vector), query, block):
        ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            kept = None
            for pdf in batches:
                keys = pdf[key].to_numpy(np.int64)
                scores = matrix @ np.stack(pdf[vector].to_numpy()).astype(np.float64).T
                scores[ids[:, None] == keys] = -np.inf
                kept = best_of(scores, keys, k, kept)
            if kept is not None:
                real = np.isfinite(kept[0])
                yield pd.DataFrame({query: np.broadcast_to(ids[:, None], kept[0].shape)[real], key: kept[1][real], "score": kept[0][real]})

        part = merged(vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, schema), query, key, k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], f"{query} bigint, rank int, {key} bigint, score double")


def cosine_nearest(weights: DataFrame, queries: DataFrame, key: str, query: str, k: int, digits: int = 9) -> DataFrame:
    """Exact top-k by cosine of sparse rows (key, term, w) for stated queries (query, term, w), themselves left out.

    No join on terms, so a term that every row has is no hot key: a block of queries goes out as a matrix over its own
    terms, and each task sums the products of its rows. Scores are compared in `digits` digits, ties go to the lesser key.
    """
    packed = lambda df, name: df.groupBy(name).agg(F.collect_list(F.struct("term", "w")).alias("v"))  # noqa: E731  (a row's terms are bounded by its length)
    docs, schema, out = packed(weights, key), f"{query} bigint, {key} bigint, score double", None
    for rows in blocks(packed(queries, query), query):
        ids, terms = np.array([r[0] for r in rows], np.int64), sorted({x.term for r in rows for x in r.v})
        at = {t: i for i, t in enumerate(terms)}
        matrix = np.zeros((len(terms), len(rows)))
        for j, r in enumerate(rows):
            for x in r.v:
                matrix[at[x.term], j] = x.w
        shared = weights.sparkSession.sparkContext.broadcast((ids, terms, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, terms, matrix = shared.value
            index, kept = pd.Index(terms), None
            for pdf in batches:
                for i in range(0, len(pdf), 500):
                    part = pdf.iloc[i : i + 500]
                    keys = part[key].to_numpy(np.int64)
                    sizes = part["v"].map(len).to_numpy()
                    flat = [x for v in part["v"] for x in v]
                    row, col, w = np.repeat(np.arange(len(part)), sizes), index.get_indexer([x["term"] for x in flat]), np.array([x["w"] for x in flat])
                    row, col, w = row[col >= 0], col[col >= 0], w[col >= 0]
                    scores = np.full((len(ids), len(part)), -np.inf)
                    if len(row):
                        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        sums = np.round(np.add.reduceat(matrix[col] * w[:, None], first, axis=0).T, digits)
                        scores[:, row[first]] = np.where(sums > 0, sums, -np.inf)
                    scores[ids[:, None] == keys] = -np.inf
                    kept = best_of(scores, keys, k, kept)
            if kept is not None:
                real = np.isfinite(kept[0])
                yield pd.DataFrame({query: np.broadcast_to(ids[:, None], kept[0].shape)[real], key: kept[1][real], "score": kept[0][real]})

        part = merged(docs.mapInPandas(run, schema), query, key, k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else weights.sparkSession.createDataFrame([], f"{query} bigint, rank int, {key} bigint, score double")
