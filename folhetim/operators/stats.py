"""Statistics of an annotated corpus: ``relatorio, tokens, bio_tags, spans``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folhetim.functions import tags as G
from folhetim.schema import ENTITY_TYPES


def entities_in(tags: Column) -> Column:
    return F.size(F.filter(tags, lambda t: t.startswith("B-")))


def sizes(units: DataFrame, *keep: str) -> DataFrame:
    return units.select(*keep, F.size("tokens").alias("n"), entities_in(F.col("bio_tags")).alias("e"), G.has_entity(F.col("bio_tags")).alias("com"))


def corpus_totals(units: DataFrame) -> DataFrame:
    s = sizes(units)
    return s.agg(F.count("*").alias("unidades"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("e"), F.lit(0)).alias("entidades"), F.count_if("com").alias("com_entidade"), F.bround(100 * F.count_if("com") / F.greatest(F.count("*"), F.lit(1)), 1).alias("parte"))


def length_stats(units: DataFrame) -> DataFrame:
    """Mean, median, standard deviation of the population, least and greatest length in tokens."""
    s = sizes(units)
    return s.agg(F.bround(F.avg("n"), 4).alias("media"), F.percentile("n", F.lit(0.5)).alias("mediana"), F.bround(F.stddev_pop("n"), 4).alias("desvio"), F.min("n").alias("minimo"), F.max("n").alias("maximo"))


def per_report(units: DataFrame) -> DataFrame:
    """Figures per report, and their total under the name TOTAL, from one aggregation."""
    s = sizes(units, "relatorio").rollup("relatorio").agg(F.grouping("relatorio").alias("g"), F.count("*").alias("unidades"), F.sum("n").alias("tokens"), F.sum("e").alias("entidades"), F.count_if("com").alias("com_entidade"))
    name = F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col("relatorio"))
    return s.select(name.alias("relatorio"), "unidades", "tokens", "entidades", "com_entidade", F.bround(100 * F.col("com_entidade") / F.col("unidades"), 1).alias("parte"), F.bround(F.col("entidades") / F.col("unidades"), 2).alias("por_unidade"))


def type_counts(units: DataFrame, *by: str) -> DataFrame:
    return units.select(*by, F.explode(F.filter("bio_tags", lambda t: t.startswith("B-"))).alias("t")).groupBy(*by, F.substring("t", 3, 100).alias("tipo")).agg(F.count("*").alias("n"))


def filled(counts: DataFrame, tagset: DataFrame) -> DataFrame:
    """Counts of all types of the tag set, 0 where there are none."""
    return tagset.join(counts, "tipo", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def type_share(units: DataFrame, tagset: DataFrame) -> DataFrame:
    all_types = filled(type_counts(units), tagset)
    total = F.greatest(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return all_types.select("tipo", "n", F.bround(100 * F.col("n") / total, 1).alias("parte"))


def type_pivot(units: DataFrame, by: str) -> DataFrame:
    """Groups by types, 0 where there are none; the types are given, so no pass finds them."""
    return type_counts(units, by).groupBy(by).pivot("tipo", list(ENTITY_TYPES)).agg(F.sum("n")).na.fill(0, list(ENTITY_TYPES))


def mentions(units: DataFrame, *keep: str) -> DataFrame:
    return units.select(*keep, F.explode("spans").alias("x")).select(*keep, F.lower(F.trim("x.texto")).alias("mencao"), "x.tipo")


def top_mentions(units: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent mentions of each type; equal counts by mention."""
    counts = mentions(units).groupBy("tipo", "mencao").agg(F.count("*").alias("n"))
    by = Window.partitionBy("tipo").orderBy(F.desc("n"), "mencao")
    return counts.withColumn("posto", F.row_number().over(by)).where(F.col("posto") <= k)


def length_histogram(units: DataFrame, width: int = 5) -> DataFrame:
    s = sizes(units)
    return s.groupBy((F.floor(F.col("n") / width) * width).cast("long").alias("de"), "com").agg(F.count("*").alias("unidades"))


def short_share(units: DataFrame, least: int = 8) -> DataFrame:
    return sizes(units).agg(F.count_if(F.col("n") < least).alias("curtas"), F.bround(100 * F.count_if(F.col("n") < least) / F.greatest(F.count("*"), F.lit(1)), 1).alias("parte"))


def cooccurrence(units: DataFrame) -> DataFrame:
    """``a, b, n``: units in which both types occur; a type's own count on the diagonal. At most as many pairs a unit as types squared."""
    kinds = units.select(F.array_distinct(F.transform(F.filter("bio_tags", lambda t: t.startswith("B-")), lambda t: F.substring(t, 3, 100))).alias("k"))
    return kinds.select(F.explode("k").alias("a"), "k").select("a", F.explode("k").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def compared(units: DataFrame, tagset: DataFrame, first: Column) -> DataFrame:
    """``tipo, parte_1, parte_2``: the types' shares in the units where ``first`` holds and in the others."""
    c = type_counts(units.withColumn("p", F.coalesce(first, F.lit(False))), "p").groupBy("tipo").agg(F.sum(F.when(F.col("p"), F.col("n"))).alias("x"), F.sum(F.when(~F.col("p"), F.col("n"))).alias("y"))
    every = Window.partitionBy(F.lit(1))
    part = lambda c: F.bround(100 * F.coalesce(F.col(c), F.lit(0)) / F.greatest(F.coalesce(F.sum(c).over(every), F.lit(0)), F.lit(1)), 1)
    return tagset.join(c, "tipo", "left").select("tipo", part("x").alias("parte_1"), part("y").alias("parte_2"))


def missing_types(units: DataFrame, tagset: DataFrame) -> DataFrame:
    return tagset.join(type_counts(units).select("tipo"), "tipo", "left_anti").select("tipo")
