"""Tokens, spans and tag sequences."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folhetim.functions import tags as G
from folhetim.operators import annotate
from folhetim.operators.locate import find_loosely, place_of


def spans_of(spark, tags, lenient=False):
    r = spark.createDataFrame([(tags,)], "t array<string>").select(G.entity_spans(F.col("t"), lenient).alias("s")).first()["s"]
    return [tuple(x) for x in r]


def test_islands(spark):
    assert spans_of(spark, ["O", "B-LOCAL", "I-LOCAL", "I-PATOGENO", "B-PATOGENO"]) == [("LOCAL", 1, 3), ("PATOGENO", 4, 5)]
    assert spans_of(spark, ["I-LOCAL", "O"]) == []
    assert spans_of(spark, ["B-LOCAL", "B-LOCAL"]) == [("LOCAL", 0, 1), ("LOCAL", 1, 2)]
    assert spans_of(spark, ["O", "O"]) == [] == spans_of(spark, [])
    assert spans_of(spark, ["B-LOCAL", "I-PATOGENO", "I-LOCAL"]) == [("LOCAL", 0, 1)]
    assert spans_of(spark, ["B-LOCAL", "I-PATOGENO"], lenient=True) == [("LOCAL", 0, 2)]


def strict(tags):
    out, open_ = [], False
    for k, t in enumerate(tags):
        if t.startswith("B-"):
            out.append([t[2:], k, k + 1])
            open_ = True
        elif t.startswith("I-") and open_ and out[-1][0] == t[2:]:
            out[-1][2] = k + 1
        else:
            open_ = False
    return [tuple(x) for x in out]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["O", "B-LOCAL", "I-LOCAL", "B-SOROTIPO", "I-SOROTIPO"]), max_size=12))
def test_islands_against_model(spark, tags):
    assert spans_of(spark, tags) == strict(tags)


def tokens(spark, text):
    return [tuple(x) for x in spark.createDataFrame([(text,)], "x string").select(G.token_offsets(F.col("x")).alias("t")).first()["t"]]


def test_offsets(spark):
    assert tokens(spark, " a\xa0bc  d ") == [("a", 1, 2), ("bc", 3, 5), ("d", 7, 8)]
    assert tokens(spark, "") == []


def tag(spark, text, spans, gold):
    df = spark.createDataFrame([(text, spans)], "texto string, s array<struct<texto:string,tipo:string>>").withColumn("o", G.token_offsets(F.col("texto")))
    df = df.withColumn("p", G.chosen_places(F.col("s"), F.col("texto")) if gold else G.first_places(F.col("s"), F.col("texto")))
    return df.select((G.gold_tags if gold else G.silver_tags)(F.col("o"), F.col("p")).alias("t")).first()["t"]


def test_silver_and_gold(spark):
    assert tag(spark, "Casos em São Paulo hoje", [("São Paulo", "LOCAL")], False) == ["O", "O", "B-LOCAL", "I-LOCAL", "O"]
    # a later span overwrites, and may leave an I- behind
    assert tag(spark, "a b c", [("a b", "LOCAL"), ("a", "PATOGENO")], False) == ["B-PATOGENO", "I-LOCAL", "O"]
    # adjacent spans of one type stay apart in silver and become one in gold
    assert tag(spark, "a b", [("a", "LOCAL"), ("b", "LOCAL")], False) == ["B-LOCAL", "B-LOCAL"]
    assert tag(spark, "a b", [("a", "LOCAL"), ("b", "LOCAL")], True) == ["B-LOCAL", "I-LOCAL"]
    # the longest span wins in gold; unknown types and missing mentions are left out
    assert tag(spark, "sorotipo 14 novo", [("14", "METRICA_EPI"), ("sorotipo 14", "SOROTIPO"), ("x", "LOCAL"), ("novo", "NADA")], True) == ["B-SOROTIPO", "I-SOROTIPO", "O"]
    assert tag(spark, "", [("a", "LOCAL")], True) == []


def test_readable(spark):
    df = spark.createDataFrame([("a → LOCAL; b → local; c; → LOCAL",), (None,), ("(nenhuma)",)], "c string").select(G.from_readable(F.col("c")).alias("s"))
    rows = [r["s"] for r in df.collect()]
    assert [tuple(x) for x in rows[0]] == [("a", "LOCAL"), ("b", "LOCAL")]
    assert rows[1] == rows[2] == []
    back = [r[0] for r in df.select(G.readable(F.col("s"))).collect()]
    assert back == ["a → LOCAL; b → LOCAL", "(nenhuma)", "(nenhuma)"]


def test_final_cell(spark):
    df = spark.createDataFrame([("s", None), ("s", "ok"), ("s", "(nenhuma)"), ("s", " c "), (None, "")], "s string, c string")
    assert [r[0] for r in df.select(G.final_cell(F.col("s"), F.col("c"))).collect()] == ["s", "ok", "s", "c", ""]
    assert [r[0] for r in df.select(G.final_cell(F.col("s"), F.col("c"), True)).collect()] == ["s", "s", "", "c", ""]


def test_numbers_and_json(spark):
    df = spark.createDataFrame([('[{"texto":"39,1 e 40","tipo":"METRICA_EPI"}]',), ("quebrado",), (None,)], "c string").select(G.numbers_apart(G.parsed_spans(F.col("c"))).alias("s"))
    assert [[tuple(x) for x in r["s"]] for r in df.collect()] == [[("39,1", "METRICA_EPI"), ("40", "METRICA_EPI")], [], []]


def test_pieces(spark):
    df = spark.createDataFrame([([5, 7], [None, 0, 0, 1, None], [-100, 5, -100, 7, -100], [1, 2, 3, 4, 5])], "l array<int>, w array<int>, a array<int>, p array<int>")
    r = df.select(G.word_pieces(F.col("l"), F.col("w")).alias("x"), G.word_predictions(F.col("a"), F.col("p")).alias("y")).first()
    assert r["x"] == [-100, 5, -100, 7, -100] and r["y"] == [2, 4]


def test_repair(spark):
    df = spark.createDataFrame([(["sorotipo", "14"], ["B-SOROTIPO", "I-SOROTIPO"], [("Sorotipo", "SOROTIPO"), ("< 5 anos", "FAIXA_ETARIA")])], "t array<string>, g array<string>, s array<struct<texto:string,tipo:string>>")
    g, s = G.repaired(F.col("t"), F.col("g"), F.col("s"))
    r = df.select(g.alias("g"), s.alias("s")).first()
    assert r["g"] == ["O", "I-SOROTIPO"] and [tuple(x) for x in r["s"]] == [("<5 anos", "FAIXA_ETARIA")]


def test_locate(spark):
    assert find_loosely("a  São\nPaulo b", "são paulo") == [3, 12]
    assert find_loosely("valor 12 , 5", "x") is None
    assert find_loosely("nota 3 / 2014", "3/2014") == [5, 13]
    df = spark.createDataFrame([("Em São Paulo", "são paulo"), ("Em São  Paulo", "São Paulo"), ("x", "y"), (None, "a")], "t string, m string")
    assert [r[0] for r in df.select(place_of(F.col("t"), F.col("m"))).collect()] == [[3, 12], [3, 13], None, None]


def test_annotators(spark):
    df = spark.createDataFrame([("u1", "Casos em Jacarei foram 12,5%"), ("u2", None)], "sentenca_id string, texto string")
    r = {x["sentenca_id"]: x for x in annotate.annotated(df).collect()}
    assert r["u1"]["bio_tags"] == ["B-LOCAL", "O", "B-LOCAL", "O", "B-METRICA_EPI"] and r["u2"]["bio_tags"] == []
    replies = lambda texts: ['{"entidades":[{"texto":"a","tipo":"LOCAL"}]}' if t else None for t in texts]
    got = {x["sentenca_id"]: x["spans"] for x in annotate.by_model(df, "sentenca_id", "texto", replies).collect()}
    assert [tuple(x) for x in got["u1"]] == [("a", "LOCAL")] and got["u2"] == []


def test_gold_finds_loosely(spark):
    from folhetim.operators import gold

    rows = [(1, "Em São  Paulo houve S . pneumoniae", "ok", [("São Paulo ", "local"), ("S. pneumoniae", "PATOGENO")], []), (2, "sem", "ok", [("nada", "LOCAL"), ("x", "OUTRO")], None), (3, "", "ok", None, None)]
    df = spark.createDataFrame(rows, "linha int, texto string, status string, spans_silver array<struct<texto:string,tipo:string>>, spans_correto array<struct<texto:string,tipo:string>>")
    got = {r["linha"]: (r["bio_tags"], [tuple(x) for x in r["spans"]]) for r in gold.build_gold(df).collect()}
    assert got[1] == (["O", "B-LOCAL", "I-LOCAL", "O", "B-PATOGENO", "I-PATOGENO", "I-PATOGENO"], [("São Paulo", "LOCAL"), ("S . pneumoniae", "PATOGENO")])
    assert got[2] == (["O"], []) and 3 not in got
