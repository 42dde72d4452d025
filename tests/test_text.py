"""String cases of tables, sentences and prose."""

import pytest
from pyspark.sql import functions as F

from folhetim.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("line", "table", "separator"), [("| a | b |", True, False), ("|---|:--:|", True, True), ("a | b", False, False), ("", False, False), (None, False, False), ("  | x | y", True, False), ("| sozinho", False, False)])
def test_table_lines(spark, line, table, separator):
    assert one(spark, line, T.is_table_line) is table
    assert bool(one(spark, line, T.is_separator_line)) is separator


def test_table_blocks(spark):
    assert one(spark, "antes\n| a | b |\n|---|---|\ndepois", T.without_tables) == "antes\n\ndepois"
    assert one(spark, "antes\n\n| a | b |\ndepois", T.without_tables) == "antes\n\ndepois"
    assert one(spark, "só texto", T.without_tables) == "só texto"
    assert one(spark, "| a | b |", T.without_tables) == ""
    assert one(spark, None, T.without_tables) is None


def test_sentences(spark):
    assert one(spark, "Um caso. Dois casos! 3 casos? É outro. Ate aqui", T.sentences) == ["Um caso.", "Dois casos!", "3 casos? É outro.", "Ate aqui"]
    assert one(spark, "Frase longa o bastante. Curta. Outra frase longa aqui.", lambda c: T.fold_short(T.sentences(c))) == ["Frase longa o bastante. Curta.", "Outra frase longa aqui."]
    assert one(spark, "", T.sentences) == []


@pytest.mark.parametrize(("text", "prose"), [("Houve elevação de casos.", True), ("curta", False), ("Capítulo 1 ........ 12", False), ("12 34 56 78 90 12 34", False), ("", False), (None, False)])
def test_narrative(spark, text, prose):
    assert one(spark, text, T.is_narrative) is prose


def test_cells_and_captions(spark):
    assert one(spark, None, T.clean_cell) == ""
    assert one(spark, "  a\xa0 b\n c ", T.clean_cell) == "a b c"
    assert one(spark, "x\nTabela 3. Casos por idade\ny", T.caption_of) == "Tabela 3. Casos por idade"
    assert one(spark, "sem", T.caption_of) == ""
    assert one(spark, " ( Nenhuma ) ", T.says_none) is True
    assert one(spark, None, T.says_none) is False
    assert one(spark, "12", T.whole_number) == 12
    assert one(spark, "x", T.whole_number) == 0


def test_long_text(spark):
    assert len(one(spark, "Uma frase bem comum aqui. " * 2000, T.sentences)) == 2000
