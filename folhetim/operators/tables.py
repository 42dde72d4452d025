"""Raw tables of documents to row units: one sentence per data row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhetim.functions.text import clean_cell

NUMERIC = r"^[\d,.\-+%]+$"


def cleaned(rows: Column) -> Column:
    """All cells cleaned; the shape, which may be ragged, stays."""
    return F.transform(rows, lambda r: F.transform(r, clean_cell))


def is_garbled(rows: Column, most: float = 0.30) -> Column:
    """Whether a table has no cell with text, or too many cells of one character."""
    full = F.filter(F.flatten(rows), lambda c: c != "")
    single = F.size(F.filter(full, lambda c: F.length(c) == 1))
    return (F.size(full) == 0) | (single > most * F.size(full))


def full_columns(rows: Column) -> Column:
    """The rows over the columns that hold any text; missing cells are ''."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda r, i: F.coalesce(F.try_element_at(r, i), F.lit(""))
    kept = F.filter(F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>")), lambda i: F.exists(rows, lambda r: cell(r, i) != ""))
    return F.transform(rows, lambda r: F.transform(kept, lambda i: cell(r, i)))


def header_and_data(rows: Column) -> Column:
    """``struct<header, data>``: the first row with over half its cells numeric, and all after it, are data; empty rows are dropped."""

    def numeric(r: Column) -> Column:
        full = F.filter(r, lambda c: c != "")
        return F.size(F.filter(full, lambda c: c.rlike(NUMERIC))) > 0.5 * F.size(full)

    empty = F.array().cast("array<array<string>>")
    start = F.struct(empty.alias("header"), empty.alias("data"))

    def step(acc: Column, r: Column) -> Column:
        is_data = (F.size(acc["data"]) > 0) | numeric(r)
        return F.struct(F.when(is_data, acc["header"]).otherwise(F.concat(acc["header"], F.array(r))).alias("header"), F.when(is_data, F.concat(acc["data"], F.array(r))).otherwise(acc["data"]).alias("data"))

    return F.aggregate(F.filter(rows, lambda r: F.exists(r, lambda c: c != "")), start, step)


def labels(header: Column) -> Column:
    """A label per column: its different texts in the header rows, joined."""
    width = F.coalesce(F.array_max(F.transform(header, lambda r: F.size(r))), F.lit(0))
    columns = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
    return F.transform(columns, lambda i: F.array_join(F.array_distinct(F.filter(F.transform(header, lambda r: F.coalesce(F.try_element_at(r, i), F.lit(""))), lambda c: c != "")), " "))


def row_sentence(caption: Column, names: Column, row: Column) -> Column:
    """``caption | label: value | ...``: empty values are left out, a value without label is bare, and columns without a label list are lost."""
    n = F.least(F.size(names), F.size(row))
    pairs = F.arrays_zip(F.slice(names, F.lit(1), n).alias("l"), F.slice(row, F.lit(1), n).alias("v"))
    parts = F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.when(p["l"] != "", F.concat(p["l"], F.lit(": "), p["v"])).otherwise(p["v"]))
    return F.array_join(F.concat(F.filter(F.array(caption), lambda c: c != ""), parts), " | ")


def table_rows(tables: DataFrame, captions: DataFrame, least: int = 10) -> DataFrame:
    """``relatorio, pagina, tabela, linha, texto, tipo``: the sentences of data rows.

    ``tables``: ``relatorio, pagina, tabela, celulas array<array<string>>``; ``captions``: ``relatorio,
    pagina, legenda``. Garbled tables, rows of fewer than two full cells, subtotals and totals, and
    sentences shorter than ``least`` are left out. A table without header rows keeps its caption alone.
    """
    clean = tables.withColumn("celulas", cleaned(F.col("celulas"))).where(~is_garbled(F.col("celulas")))
    split = clean.withColumn("celulas", full_columns(F.col("celulas"))).withColumn("p", header_and_data(F.col("celulas")))
    named = split.withColumn("l", labels(F.col("p.header"))).join(captions, ["relatorio", "pagina"], "left")
    rows = named.select("relatorio", "pagina", "tabela", "l", F.coalesce("legenda", F.lit("")).alias("legenda"), F.posexplode("p.data").alias("linha", "r"))
    full = rows.where((F.size(F.filter("r", lambda c: c != "")) >= 2) & ~F.coalesce(F.try_element_at("r", F.lit(1)), F.lit("")).rlike(r"(?i)^(subtotal|total)\b"))
    done = full.withColumn("texto", row_sentence(F.col("legenda"), F.col("l"), F.col("r"))).where(F.length("texto") >= least)
    return done.select("relatorio", "pagina", "tabela", "linha", "texto", F.lit("tabela").alias("tipo"))
