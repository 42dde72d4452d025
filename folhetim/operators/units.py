"""Documents to text units, and selections of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folhetim.functions import text as T


def last_delivery(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last by ``order`` (nulls first); rows without a key are left out.

    Rows that tie in ``order`` are told apart by their other columns, so the result is determined.
    """
    rest = sorted(c for c in df.columns if c not in order and c != key)
    by = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in (*order, *rest)])
    return df.where(F.col(key).isNotNull()).withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def split_units(documents: DataFrame, key: str, text: str, least: int = T.SHORT_FRAGMENT) -> DataFrame:
    """``key, posicao, texto``: the narrative sentences of each document, in order, from 0.

    Table lines are taken out, paragraphs and sentences cut, short fragments folded into the sentence
    before, and what is not prose dropped. Null and empty texts give no rows.
    """
    found = F.flatten(F.transform(T.paragraphs(T.without_tables(F.col(text))), lambda p: T.fold_short(T.sentences(p), least)))
    kept = documents.select(key, F.posexplode(F.filter(found, lambda s: T.is_narrative(s, least))).alias("posicao", "texto"))
    return kept


def numbered_units(units: DataFrame, report: str, *order: str, kind: str = "s") -> DataFrame:
    """``units`` with ``sentenca_id``: the report, ``_s`` and a running number of four or more digits in ``order``."""
    n = F.row_number().over(Window.partitionBy(report).orderBy(*order))
    return units.withColumn("sentenca_id", F.format_string(f"%s_{kind}%04d", F.col(report), n))


def structured_or_flat(structured: DataFrame, flat: DataFrame, key: str) -> DataFrame:
    """Structured rows, and flat ones of the keys that have no structured row."""
    return structured.unionByName(flat.join(structured.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union by key in which the right side's rows replace the left side's."""
    return right.unionByName(left.join(right.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default) -> DataFrame:
    """A lookup by key that gives ``default`` where there is none."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))
