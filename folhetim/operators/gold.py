"""Reviewed rows to gold units, with counters, from CSV review and from an annotation tool's export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhetim.functions import tags as G
from folhetim.operators.locate import loose_places


def route(status: Column) -> Column:
    """What a review status means: corrigido, erro, pulado, pendente, or else ok; a null column is pendente by the caller."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s == "corrigido", "corrigido").when(s == "erro", "erro").when(s.isin("skip", "ignorar"), "pulado").when(s == "pendente", "pendente").otherwise("ok")


def routed_spans(status: Column, silver: Column, fixed: Column) -> Column:
    """The spans that hold: the corrected ones of corrected rows where there are any, the silver ones of others."""
    return F.when((route(status) == "corrigido") & (F.size(fixed) > 0), fixed).otherwise(silver)


def counters(rows: DataFrame, status: str, text: str) -> DataFrame:
    """One row of counts by route; ``sem_texto`` counts empty texts, which were counted under their route before."""
    r = route(F.col(status))
    return rows.agg(F.count("*").alias("total"), *[F.count_if(r == k).alias(k) for k in ("ok", "corrigido", "erro", "pulado", "pendente")], F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("sem_texto"))


def build_gold(rows: DataFrame, text: str = "texto", status: str = "status", silver: str = "spans_silver", fixed: str = "spans_correto") -> DataFrame:
    """Rows with ``tokens, bio_tags, spans``: routed, tagged longest span first, spans read back from the tags.

    Erroneous and skipped rows and empty texts are left out; pending rows stay, with their silver spans.
    """
    kept = rows.where(~route(F.col(status)).isin("erro", "pulado") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    chosen = kept.withColumn("__s", routed_spans(F.col(status), F.col(silver), F.col(fixed)))
    loose = chosen.withColumn("__l", loose_places(F.col("__s"), F.col(text)))
    off = loose.withColumn("__o", G.token_offsets(F.col(text))).withColumn("__p", G.chosen_places(F.col("__s"), F.col(text), F.col("__l")))
    tagged = off.withColumn("tokens", F.transform("__o", lambda o: o["token"])).withColumn("bio_tags", G.gold_tags(F.col("__o"), F.col("__p")))
    return tagged.withColumn("spans", G.span_texts(F.col("bio_tags"), F.col("tokens"))).drop("__s", "__l", "__o", "__p")


def from_export(tasks: DataFrame, annotator: int = 1) -> DataFrame:
    """``relatorio, pagina, sentenca_id, texto, spans`` of an export: the first annotation of ``annotator`` that isn't cancelled; numbers apart."""
    first = F.try_element_at(F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)) & (a["completed_by"] == annotator)), F.lit(1))
    spans = F.transform(F.filter(first["result"], lambda r: r["value"]["text"].isNotNull() & (F.size(r["value"]["labels"]) > 0)), lambda r: F.struct(r["value"]["text"].alias("texto"), r["value"]["labels"][0].alias("tipo")))
    d = tasks.where(first.isNotNull()).select("data.relatorio", F.coalesce(F.col("data.pagina").cast("int"), F.lit(0)).alias("pagina"), "data.sentenca_id", F.col("data.text").alias("texto"), spans.alias("s"))
    return d.withColumn("spans", G.numbers_apart(F.col("s"))).drop("s")
