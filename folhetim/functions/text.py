"""Column functions for normalising, splitting and filtering text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it; Java and RE2 share the notation.
BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTER = "a-zA-ZÀ-ÿ"
SHORT_FRAGMENT = 15


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def clean_cell(c: Column) -> Column:
    """A cell with null as '', runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{BLANK}]+", " "))


def is_table_line(c: Column) -> Column:
    """Whether a line starts with a pipe and has another one."""
    return F.coalesce(c.rlike(r"^\s*\|.*\|"), F.lit(False))


def is_separator_line(c: Column) -> Column:
    """Whether a table line is of pipes, colons, dashes and blanks alone."""
    return is_table_line(c) & (F.translate(F.trim(c), "|: -", "") == "")


def paragraphs(c: Column) -> Column:
    """``array<string>``: pieces between blank lines, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(c, r"\n{2,}"), strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """``array<string>``: a paragraph cut after . ! ? before a plain capital or a digit, one to three blanks between."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s{1,3}(?=[A-Z0-9])"), strip), lambda s: s != "")


def fold_short(fragments: Column, least: int = SHORT_FRAGMENT) -> Column:
    """Fragments shorter than ``least`` go to the end of the one before, if there is one."""

    def step(done: Column, x: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), x)))
        return F.when((F.size(done) > 0) & (F.length(x) < least), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(fragments, F.array().cast("array<string>"), step)


def is_narrative(c: Column, least: int = SHORT_FRAGMENT) -> Column:
    """Whether a sentence is prose: long enough, without dot leaders, with a run of three letters."""
    return F.coalesce((F.length(c) >= least) & ~c.rlike(r"\.{3,}") & c.rlike(rf"[{LETTER}]{{3,}}"), F.lit(False))


def without_tables(c: Column) -> Column:
    """Text without its runs of table lines; after a run stands one blank line if the line kept before is not blank."""
    lines = F.split(c, "\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside"))

    def step(acc: Column, line: Column) -> Column:
        kept = acc["kept"]
        gap = acc["inside"] & (F.size(kept) > 0) & (F.trim(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))) != "")
        spaced = F.when(gap, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.when(is_table_line(line), F.struct(kept.alias("kept"), F.lit(True).alias("inside"))).otherwise(F.struct(F.concat(spaced, F.array(line)).alias("kept"), F.lit(False).alias("inside")))

    def finish(acc: Column) -> Column:
        kept = acc["kept"]
        gap = acc["inside"] & (F.trim(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))) != "")
        return F.array_join(F.when(gap, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "\n")

    return F.when(c.isNotNull(), F.aggregate(lines, start, step, finish))


def good_length(tokens: Column, text: Column) -> Column:
    """8 to 60 tokens, not all capitals, half the tokens or more with a letter."""
    lettered = F.size(F.filter(tokens, lambda t: t.rlike(r"\p{L}")))
    capitals = (text == F.upper(text)) & (text != F.lower(text))
    return F.size(tokens).between(8, 60) & ~capitals & (lettered >= 0.5 * F.size(tokens))


def year_of(report: Column) -> Column:
    """The year of a report's name, as a string."""
    return F.replace(report, F.lit("sireva_"), F.lit(""))


def says_none(c: Column) -> Column:
    """Whether a cell says that there are no mentions."""
    return F.coalesce(c.rlike(r"(?i)^\s*\(?\s*nenhuma\s*\)?\s*$"), F.lit(False))


def caption_of(page_text: Column) -> Column:
    """The first caption of a page, '' where it has none."""
    return clean_cell(F.regexp_extract(page_text, r"(?i)(tabela\s*\d+[.:]?\s*[^\n]{5,80})", 1))


def whole_number(c: Column) -> Column:
    """A field as a whole number, 0 where it is empty, null or none."""
    return F.coalesce(c.try_cast("int"), F.lit(0))
