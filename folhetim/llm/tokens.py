"""Sizes of texts in tokens of a public tokenizer; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level BPE cuts text before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str = VOCABULARY):
    """A column function: tokens of a text; 0 for null and ''."""

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for s in texts:
            yield s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return F.pandas_udf(count, LongType())


# the annotations of a nested function are names to pandas_udf only if they can be resolved
count_tokens.__annotations__.clear()


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the whole text's size in tokens."""
    return df.withColumn(out, count_tokens(path)(F.col(text)))
