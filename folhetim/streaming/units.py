"""Streams of unit deliveries. Beyond the reference, which has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deliveries_once(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each unit once per stream: a unit delivered again within ``delay`` of the first is dropped."""
    return stream.withWatermark("carregado_em", delay).dropDuplicatesWithinWatermark(["sentenca_id"])


def deliveries_per_day(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """``dia, relatorio, n``: deliveries by day and report; rows later than ``delay`` are dropped."""
    day = F.window("carregado_em", "1 day")
    return stream.withWatermark("carregado_em", delay).groupBy(day.alias("w"), "relatorio").agg(F.count("*").alias("n")).select(F.col("w.start").alias("dia"), "relatorio", "n")
