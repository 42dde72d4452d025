"""Readers and writers of the corpus's files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folhetim.operators.units import last_delivery
from folhetim.schema import TEXT_UNIT


def read_units(spark: SparkSession, path: str, schema: StructType = TEXT_UNIT) -> DataFrame:
    """JSON lines, one file or a folder of them; blank lines are skipped, bad ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_units_last_wins(spark: SparkSession, path: str, schema: StructType = TEXT_UNIT) -> DataFrame:
    """As ``read_units``, one row per ``sentenca_id``: of files in order of name, the last one's."""
    rows = read_units(spark, path, schema).select("*", F.col("_metadata.file_path").alias("__arquivo"), F.col("_metadata.file_block_start").alias("__bloco"), F.monotonically_increasing_id().alias("__linha"))
    return last_delivery(rows, "sentenca_id", "__arquivo", "__bloco", "__linha").drop("__arquivo", "__bloco", "__linha")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A review CSV with header, quoted commas and line breaks, with or without byte-order mark; empty cells are ''."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])


def read_tasks(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON array of annotation tasks, one row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """``relatorio, pagina, item, texto, erro`` of binary documents.

    ``extract`` turns a file's bytes into (page, text) items. A file that fails gives one row with its
    error and page 0, so that one bad file doesn't fail the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows += [(name, page, i, text, None) for i, (page, text) in enumerate(extract(content))]
                except Exception as e:  # noqa: BLE001
                    rows.append((name, 0, 0, None, repr(e)))
            if rows:
                yield pd.DataFrame(rows, columns=["relatorio", "pagina", "item", "texto", "erro"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "relatorio string, pagina int, item int, texto string, erro string")


# ---- writers


def write_units(df: DataFrame, path: str, by_report: bool = False, force: bool = True) -> None:
    """JSON lines, null fields kept; one folder per report if wanted; left alone if there and not forced."""
    w = df.write.mode("overwrite" if force else "ignore").option("ignoreNullFields", False)
    (w.partitionBy("relatorio") if by_report else w).json(path)


def write_metrics(scores: DataFrame, path: str, averages: tuple[str, ...] = ("micro avg", "macro avg", "weighted avg")) -> None:
    """A metric CSV of a few rows: types by name, then the averages in the order given."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, averages)), F.col("entity")), F.lit(0))
    scores.withColumn("__o", order).orderBy("__o", "entity").drop("__o").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_review(df: DataFrame, path: str) -> None:
    """A review CSV with quoted cells; the first header cell starts with a byte-order mark."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def annotation_tasks(units: DataFrame, model: str = "silver") -> DataFrame:
    """``value``: one JSON task per unit with its predicted spans (``char_spans`` in column ``marcas``)."""
    result = F.transform("marcas", lambda m: F.struct(m["id"].alias("id"), F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), F.struct(m["s"].alias("start"), m["e"].alias("end"), m["texto"].alias("text"), F.array(m["tipo"]).alias("labels")).alias("value")))
    data = F.struct(F.col("texto").alias("text"), "sentenca_id", "relatorio", F.coalesce("pagina", F.lit(0)).alias("pagina"))
    return units.select(F.to_json(F.struct(data.alias("data"), F.array(F.struct(F.lit(model).alias("model_version"), result.alias("result"))).alias("predictions"))).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    """A report frame of a few rows as indented JSON on the driver; more than 10,000 rows are refused."""
    rows = df.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a report has at most 10,000 rows")
    Path(path).write_text(json.dumps([r.asDict(True) for r in rows], ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def latex_rows(df: DataFrame) -> DataFrame:
    """``linha``: each row as a LaTeX table line."""
    return df.select(F.concat(F.concat_ws(" & ", *[F.col(c).cast("string") for c in df.columns]), F.lit(r" \\")).alias("linha"))


