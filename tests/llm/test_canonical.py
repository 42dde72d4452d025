"""Problem 7: one form."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folhetim.llm import canonical as C


def test_forms():
    f = C.canonical_text
    assert f("Ｄａｎá １５，０９％") == "Daná 15,09%"
    assert f("vaсinação") == "vacinação"
    assert f("Sile‍̂falema") == "Silêfalema"
    assert f("re⁠lação\xa0a b　c") == "relação a b c"
    assert f("Ruloο̃b") == "Ruloõb"
    for kept in ("teste de β-lactamase", "0,5 µg/ml", "1ª nº m² ≥ ≤", "linha\nnova\tx", "привет", ""):
        assert f(kept) == kept
    # a real Greek or Cyrillic word stays, although some of its letters look Latin
    assert f("да") == "да" and f("προς") == "προς"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeоаｅ́̃​\xa0 βx１", max_size=12))
def test_fixed_point(text):
    once = C.canonical_text(text)
    assert C.canonical_text(once) == once
    assert once == unicodedata.normalize("NFC", once)


def test_conflicts_are_found():
    table = C.mapping()
    assert not [v for v in table.values() if v in table]


def test_coarse_class_holds_the_mapping(spark):
    chars = list(C.mapping())
    df = spark.createDataFrame([(f"x{c}y",) for c in chars], "t string")
    assert df.where(~C.is_affected(F.col("t"))).count() == 0


def test_table(spark):
    df = spark.createDataFrame([("a", "vaсina", "z"), ("a", "vaсina", "z"), ("b", None, "z"), ("c", "", "z"), ("d", "β", "z"), ("e", "ｘ" * 100_000, None)], "sentenca_id string, texto string, forma string")
    assert sorted(r[0] for r in C.variants(df, "sentenca_id", "texto").collect()) == ["a", "e"]
    got = C.canonical(df.drop("forma"), "texto", "forma").collect()
    assert [r["forma"] for r in got][:5] == ["vacina", "vacina", None, "", "β"]
    assert C.variants(df.limit(0), "sentenca_id", "texto").count() == 0


def test_widths():
    assert C.canonical_text("￥５０ ｶﾀ ￣") == "¥50 カタ ¯"
