"""Exact set-similarity join of texts on word shingles by prefix filtering.

Exact copies fall into one class first. The shingles of all texts have one order, those of rare words first; of each distinct
text the first ones are its prefix, as many as leave no way for a pair of Jaccard >= threshold to share none. Only prefixes are
moved, with a parity sketch of the whole set that bounds how much two sets differ; pairs that share a prefix shingle and pass
are verified on whole shingle sets, which are made anew from their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.session import scratch_path

SHINGLE, THRESHOLD = 5, 0.8
COUNT_BITS, SLICES = 18, 16  # word counts are kept in 2 ** COUNT_BITS hash bins, added up in slices
ONCE = 255  # class of the bins of one word at most: no other text has a shingle with it
SKETCHED = ("n", "s0", "s1")


def worded(df: DataFrame, key: str, text: str, *extra: str) -> DataFrame:
    """id, w (the text's words in lower case) and further columns, of texts that aren't NULL."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), words.alias("w"), *extra)


def shingled(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, s (distinct shingle hashes; a text of fewer words is one shingle). NULL and blank texts are left out."""
    t = worded(df, key, text).where("size(w) > 0")
    n = F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))
    return t.select("id", F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice("w", i, SHINGLE), " ")))).alias("s"))


def hashed(df: DataFrame, key: str, text: str, *extra: str) -> DataFrame:
    """id, further columns, h (hash of the text's words), w (hash of each word)."""
    return worded(df, key, text, *extra).select("id", *extra, F.xxhash64(F.array_join("w", " ")).alias("h"), F.transform("w", lambda w: F.xxhash64(w)).alias("w"))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a column of lists one after the other, and how many each list has."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(lists.offsets.to_numpy())


def word_classes(rows: DataFrame) -> np.ndarray:
    """Per hash bin a class of how often its words stand in all the rows: quarter powers of two; ONCE below two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            total += np.bincount((flat(batch.column("w"))[0] >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": np.arange(SLICES, dtype=np.int32), "counts": [zlib.compress(x.tobytes(), 1) for x in np.split(total, SLICES)]}), preserve_index=False)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
        classes = np.where(total < 2, ONCE, np.floor(4 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "classes": [classes.tobytes()]})

    out = np.full((SLICES, (1 << COUNT_BITS) // SLICES), ONCE, np.uint8)
    for r in rows.select("w").mapInArrow(run, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, classes binary").collect():  # SLICES rows, a quarter of a megabyte in all
        out[r.part] = np.frombuffer(r.classes, np.uint8)
    return out.ravel()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def prefixes(word: np.ndarray, counts: np.ndarray, classes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of one word at least: number of distinct shingles, sketch (two integers), how many prefix shingles, and these."""
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(word)) - (np.cumsum(counts) - counts)[text]
    first = np.flatnonzero(at < np.maximum(counts - (SHINGLE - 1), 1)[text])
    text, at = text[first], at[first]
    h, rank, once = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64), np.zeros(len(first), bool)
    for j in range(SHINGLE):
        there = at + j < counts[text]
        w = word[np.minimum(first + j, len(word) - 1)]
        c = classes[w >> np.uint64(64 - COUNT_BITS)]
        with np.errstate(over="ignore"):
            h = mixed(h * np.uint64(0x100000001B3) + np.where(there, w, np.uint64(7)))
        rank += np.where(there, c, 0).astype(np.uint64)
        once |= there & (c == ONCE)
    # the rank of a shingle and its hash are one integer, so that equal shingles stand together
    rank = np.where(once, np.uint64(0), rank + np.uint64(1)) << np.uint64(52) | h >> np.uint64(12)
    order = np.lexsort((rank, text))
    text, rank, h, once = text[order], rank[order], h[order], once[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (rank[1:] != rank[:-1])])
    text, rank, h, once = text[new], rank[new], mixed(h[new]), once[new]
    n = np.bincount(text, minlength=len(counts))
    starts = np.cumsum(n) - n
    bit = h & np.uint64(127)
    sketch = np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == i, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), starts) for i in range(2)], 1)
    length = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
    kept = (np.arange(len(text)) - starts[text] < length[text]) & ~once
    return n, sketch.view(np.int64), np.bincount(text[kept], minlength=len(counts)), (rank[kept] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def sketched(rows: DataFrame, classes: np.ndarray, threshold: float) -> DataFrame:
    """Rows of `hashed` without their words but with n (distinct shingles), s0, s1 (parity sketch), px (prefix, as hashes of 32 bits); texts without words are left out."""
    kept = [f for f in rows.schema.fields if f.name != "w"]
    schema = T.StructType([*kept, T.StructField("n", T.IntegerType()), T.StructField("s0", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("px", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                word, counts = flat(batch.column("w"))
                if not len(word):
                    continue
                n, sketch, sizes, px = prefixes(word, counts[counts > 0], classes, threshold)
                rest = batch.filter(pa.array(counts > 0))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(px))
                columns = [*(rest.column(f.name) for f in kept), pa.array(n.astype(np.int32)), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), lists]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def similar_pairs(classes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) between class representatives, a < b; classes: id, n, s0, s1, px; texts: id, text of at least these."""
    spark = classes.sparkSession
    path = scratch_path(spark, "similar")
    prefix = classes.select("id", *SKETCHED, F.explode("px").alias("x"))
    a, b = (prefix.select("x", F.col("id").alias(y), *(F.col(c).alias(f"{c}_{y}") for c in SKETCHED)) for y in "ab")
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCHED[1:]), F.lit(0))
    near = (F.least("n_a", "n_b") + 1e-6 >= threshold * F.greatest("n_a", "n_b")) & (differ <= (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6)
    a.join(b, "x").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct().write.parquet(path)
    pairs = spark.read.parquet(path)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = scratch_path(spark, "shingles")
    shingled(texts.join(ids, "id", "left_semi"), "id", "text").write.parquet(sets)
    s = spark.read.parquet(sets)
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.withColumn("jaccard", F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def links(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id (the first of its exact copies), n_links (similar classes), first_link (smallest similar class or its own)."""
    rows = hashed(df, key, text)
    path = scratch_path(df.sparkSession, "prefixes")
    sketched(rows, word_classes(rows), threshold).write.parquet(path)
    t = df.sparkSession.read.parquet(path)
    classes = t.groupBy("h").agg(F.min_by(F.struct("id", *SKETCHED, "px"), "id").alias("x")).select("h", "x.*")
    pairs = similar_pairs(classes, df.select(F.col(key).alias("id"), F.col(text).alias("text")), threshold)
    each = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    per = each.groupBy("class_id").agg(F.count("*").alias("n_links"), F.min("other").alias("first"))
    first = t.groupBy("h").agg(F.min("id").alias("class_id"))
    return t.select("id", "h").join(first, "h").join(per, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.least("class_id", F.coalesce("first", "class_id")).alias("first_link"))
