"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = os.environ.get("GUESTLENS_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATTERN = regex.compile(SPLIT)
PIECE = 20_000  # characters encoded at once, and a word more


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("guestlens", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = RANKS) -> int:
    """Tokens of the whole text; very long texts are encoded piece by piece, cut where the tokenizer's own pattern splits."""
    enc = encoding(path)
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    n, i = 0, 0
    for m in PATTERN.finditer(text):
        if m.end() - i >= PIECE:
            n += len(enc.encode_ordinary(text[i : m.end()]))
            i = m.end()
    return n + len(enc.encode_ordinary(text[i:]))


def with_sizes(df: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """df without its text but with n_tokens; NULL counts 0."""
    kept = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[f.name for f in kept]].copy()
            out["n_tokens"] = [count(t, path) if t else 0 for t in pdf[text]]
            yield out

    return df.select(*[F.col(f.name) for f in kept], text).mapInPandas(run, T.StructType([*kept, T.StructField("n_tokens", T.LongType())]))
