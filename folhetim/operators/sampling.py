"""Stratified samples: exact proportional allocation, seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocation(strata: DataFrame, stratum: str, count: str, n: int, least: int = 0, pool: str | None = None) -> DataFrame:
    """``strata`` with ``alocado``: ``least`` each, the rest in proportion by largest remainders, cut to what there is.

    Equal remainders go by the stratum's name. What a cut takes away is not shared out again, and
    minimums may add up to more than ``n``. ``strata`` has a row per stratum (and ``pool``, allocated on its own): few.
    """
    every = Window.partitionBy(F.col(pool) if pool else F.lit(1))
    rest = F.greatest(F.lit(0), F.lit(n) - least * F.count("*").over(every))
    exact = F.col(count) / F.sum(count).over(every) * rest
    base = strata.withColumn("__x", exact).withColumn("__q", F.floor("__x")).withColumn("__r", F.col("__x") - F.col("__q"))
    left = rest - F.sum("__q").over(every)
    by = Window.partitionBy(F.col(pool) if pool else F.lit(1)).orderBy(F.desc("__r"), stratum)
    extra = F.when(F.row_number().over(by) <= left, 1).otherwise(0)
    return base.withColumn("alocado", F.least(F.col(count), F.col("__q") + least + extra).cast("long")).drop("__x", "__q", "__r")


def split_strata(allocated: DataFrame, with_entity: str, without: str, share: float = 0.5) -> DataFrame:
    """``com, sem``: an allocation split between units with and without entity, rounded half to even.

    A shortage on one side is filled from the other.
    """
    want = F.bround(F.col("alocado") * share).cast("long")
    yes = F.least(want, F.col(with_entity))
    no = F.least(F.col("alocado") - yes, F.col(without))
    return allocated.withColumn("sem", no).withColumn("com", F.least(F.col(with_entity), F.col("alocado") - no))


def draw_order(key: Column, seed: int) -> Column:
    """The order of a seeded draw: by md5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def drawn(units: DataFrame, quotas: DataFrame, strata: list[str], quota: str, key: str, seed: int, most: int) -> DataFrame:
    """The first ``quota`` units of each stratum in the order of the draw. ``most``: no quota is larger.

    The rank is cut at ``most`` before the shuffle, so a stratum's task gets a bounded number of rows from each partition.
    """
    by = Window.partitionBy(*strata).orderBy(draw_order(F.col(key), seed), key)
    ranked = units.withColumn("__k", F.row_number().over(by)).where(F.col("__k") <= most)
    return ranked.join(quotas.select(*strata, F.col(quota).alias("__q")), strata).where("__k <= __q").drop("__k", "__q")
