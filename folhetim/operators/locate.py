"""Where a reviewed mention stands in its text, with forgiving strategies for what plain search misses."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from folhetim.functions import tags as G


def find_loosely(text: str, mention: str) -> list[int] | None:
    """Start and end of the mention: blanks of any kind and number between words, or none or some around ``. - /``."""
    words = mention.split()
    if not text or not words:
        return None
    spaced = r"\s+".join(map(re.escape, words))
    loose = "".join(rf"\s*{re.escape(c)}\s*" if c in ".-/" else r"\s+" if c == " " else re.escape(c) for c in " ".join(words))
    for pattern in (spaced, loose):
        if m := re.search(pattern, text, re.IGNORECASE):
            inside = m.group()
            start = m.start() + len(inside) - len(inside.lstrip())
            return [start, start + len(inside.strip())]
    return None


@F.pandas_udf(ArrayType(IntegerType()))
def _loose(texts: pd.Series, mentions: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or m is None else find_loosely(t, m) for t, m in zip(texts, mentions)])


def place_of(text: Column, mention: Column) -> Column:
    """``array<int>``: start and end, null where it is nowhere. Only what the JVM's search misses goes to Python."""
    at = F.call_function("locate", F.lower(mention), F.lower(text))
    missed = (at == 0) | (mention == "")
    found = F.when(~missed, F.array(at - 1, at - 1 + F.length(mention)))
    return F.coalesce(found, _loose(F.when(missed, text), F.when(missed, mention)))


PLACES = ArrayType(StructType([StructField("s", IntegerType()), StructField("e", IntegerType())]))


@F.pandas_udf(PLACES)
def _all_loose(texts: pd.Series, mentions: pd.Series) -> pd.Series:
    def places(text, names):
        if text is None or names is None:
            return None
        found = [find_loosely(text, m) for m in names]
        return [None if f is None else {"s": f[0], "e": f[1]} for f in found]

    return pd.Series([places(t, m) for t, m in zip(texts, mentions)])


def loose_places(spans: Column, text: Column) -> Column:
    """``array<struct<s,e>>``: for each of the ``valid_spans`` where a loose search finds it.

    Null where the plain search finds all of them: only other rows go to Python.
    """
    mentions = F.transform(G.valid_spans(spans), lambda x: x["texto"])
    missed = F.exists(mentions, lambda m: F.call_function("locate", F.lower(m), F.lower(text)) == 0)
    return _all_loose(F.when(missed, text), F.when(missed, mentions))
