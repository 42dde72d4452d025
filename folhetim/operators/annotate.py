"""Annotators of units: the interface, an annotator by rules that needs no network, and prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhetim.functions import tags as G

# Patterns of the rule annotator, the first that matches decides.
RULES_A = (
    (r"^\d+(?:[.,]\d+)*%?[.,;:)]*$", "METRICA_EPI"),
    (r"(?:ite|emia|ose)[.,;:)]*$", "MANIFESTACAO_CLINICA"),
    (r"^(?:sorotipo|sorogrupo)s?[.,;:)]*$", "SOROTIPO"),
    (r"^[A-Z][a-zà-ÿ]{3,}[.,;:)]*$", "LOCAL"),
)
RULES_B = (
    (r"^\d+(?:[.,]\d+)*[.,;:)]*$", "METRICA_EPI"),
    (r"(?:ite|emia)[.,;:)]*$", "MANIFESTACAO_CLINICA"),
    (r"^(?:anos|meses)[.,;:)]*$", "FAIXA_ETARIA"),
    (r"^[A-Z][a-zà-ÿ]{3,}[.,;:)]*$", "LOCAL"),
)


def rule_type(token: Column, rules=RULES_A) -> Column:
    """The type that the first matching rule gives a token, or null."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(rules):
        out = F.when(token.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def rule_tags(tokens: Column, rules=RULES_A) -> Column:
    """IOB2 tags of tokens by rules."""
    return G.tags_of_types(F.transform(tokens, lambda t: rule_type(t, rules)))


def annotated(units: DataFrame, text: str = "texto", rules=RULES_A) -> DataFrame:
    """``units`` with ``tokens, bio_tags, spans`` by rules."""
    with_tokens = units.withColumn("tokens", G.tokens(F.coalesce(F.col(text), F.lit(""))))
    tagged = with_tokens.withColumn("bio_tags", rule_tags(F.col("tokens"), rules))
    return tagged.withColumn("spans", G.span_texts(F.col("bio_tags"), F.col("tokens")))


def by_model(units: DataFrame, key: str, text: str, annotate: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """``key, spans``: the spans that a model's JSON replies list.

    ``annotate`` gets a batch of texts and returns a reply for each, or None where the call failed; it
    does its own pacing and retries, and runs once per batch on every partition, so that a limit of
    calls must be shared out over the partitions. Failed and unreadable replies give no spans.
    """
    kind = dict(units.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"chave": b.iloc[:, 0], "resposta": annotate(["" if t is None else t for t in b.iloc[:, 1]])})

    replies = units.select(key, text).mapInPandas(run, f"chave {kind}, resposta string")
    return replies.select(F.col("chave").alias(key), G.parsed_entities(F.col("resposta")).alias("spans"))


def tagset_prompt(tagset: DataFrame, name: str, description: str, examples: str | None = None, most: int = 3) -> DataFrame:
    """One row ``prompt``: a line per type with its description and first examples, by name."""
    shown = F.concat(F.lit(" ("), F.array_join(F.slice(examples, 1, most), ", "), F.lit(")")) if examples else F.lit("")
    line = F.concat(F.lit("- "), F.col(name), F.lit(": "), F.col(description), shown)
    return tagset.select(F.col(name).alias("n"), line.alias("l")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "l"))), lambda x: x["l"]), "\n").alias("prompt"))


def remapped_turns(turns: Column) -> Column:
    """Chat turns ``role, content`` for a service that names the assistant "model": ``role, parts``."""
    return F.transform(turns, lambda t: F.struct(F.when(t["role"] == "assistant", F.lit("model")).otherwise(t["role"]).alias("role"), F.array(t["content"]).alias("parts")))
