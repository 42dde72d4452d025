"""Problem 4: scanned pages."""

import random

import pytest

from folhetim.llm import descan as D

SCHEMA = "relatorio string, pagina int, chave string, texto string"


@pytest.mark.parametrize(("seen", "meant", "yes"), [("lâm1nas", "lâminas", True), ("cornparação", "comparação", True), ("isolaclas", "isoladas", True), ("sitiiação", "situação", True), ("penicihna", "penicilina", True), ("tetraciclma", "tetraciclina", True), ("intemações", "internações", True), ("lima", "uma", False), ("casa", "caso", False), ("casa", "casa", False)])
def test_misread(seen, meant, yes):
    assert D.misread_of(seen, meant) is yes
    if yes:
        assert D.skeleton(seen) == D.skeleton(meant)


def test_skeleton_column(spark):
    from pyspark.sql import functions as F

    words = ["lâm1nas", "hum", "d0w|n!", "nlnl", "§5"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(D.skeleton_column(F.col("w"))).collect()
    assert [r[0] for r in got] == [D.skeleton(w) for w in words]


def test_join_lines():
    j = lambda t, page=3, last=45, h=None: D.join_lines(t, page, last, h or {})
    assert j("uma suscet-\n\nibilidade alta") == ("uma suscetibilidade alta", {"hifen"})
    assert j("o re-\n• 4 •\nsultado") == ("o resultado", {"hifen", "numero_pagina"})
    assert j("intervalo (n =\n859) e 24-\n59 meses –\nfim") == ("intervalo (n = 859) e 24- 59 meses – fim", set())
    assert j("casos\n333\nde meningite") == ("casos 333 de meningite", set())
    assert j("casos\n3\nde", page=None) == ("casos de", {"numero_pagina"})
    assert j("casos\n585\nde", page=None)[1] == set()
    assert j("Sulfametoxazol-\nTrimetoprim")[0] == "Sulfametoxazol-Trimetoprim"
    h = {D.fold("BOLETIM DA REDE LABORATORIAL – 2014"): "2014"}
    assert j("um\nBoletim da rede laboratorial – 2014 | 3\ndois", h=h) == ("um dois", {"cabecalho", "numero_pagina"})
    assert j("um\nBOLETIM DA REDE LAB0RATORIAL – 2014\ndois", h=h) == ("um dois", {"cabecalho"})
    assert j("") == ("", set())


def units(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfgjpvxz") + rng.choice("aeo") for _ in range(12))
    base = [("r", k, f"r_s{k:04d}", f"{name()} a situação das lâminas de penicilina foi\nBOLETIM DA REDE – 2014\nmantida em {name()}") for k in range(1, 41)]
    more = [
        ("r", 7, "m1", "a sitiiação das lâm1nas foi pontu@l"),
        ("r", 7, "m1", "a sitiiação das lâm1nas foi pontu@l"),
        ("r", None, "m2", None),
        ("r", 0, "m3", ""),
        (None, 5, "m4", "observou-\nse\n5"),
        ("r", 9, "m5", "sorotipo 22F W135 µg/ml 1ª coleta PR58309"),
    ]
    return spark.createDataFrame(base + more, SCHEMA)


def test_table(spark):
    u = units(spark)
    damage = D.Damage(u)
    by_broadcast = sorted(map(str, D.repaired(u, damage).collect()))
    assert by_broadcast == sorted(map(str, D.repaired(u, damage, broadcast_limit=0).collect()))
    got = {r["chave"]: r for r in D.repaired(u, damage).collect()}
    assert got["m1"]["texto_limpo"] == "a situação das lâminas foi pontual" and got["m1"]["defeitos"] == ["caractere"]
    assert got["m2"]["texto_limpo"] is None and got["m3"]["texto_limpo"] == "" and not got["m2"]["defeitos"]
    assert got["m4"]["defeitos"] == ["hifen", "numero_pagina"]
    assert got["m5"]["defeitos"] == []
    assert got["r_s0005"]["defeitos"] == ["cabecalho"] and "BOLETIM" not in got["r_s0005"]["texto_limpo"]


def test_empty(spark):
    u = spark.createDataFrame([], SCHEMA)
    assert D.repaired(u, D.Damage(u)).count() == 0


def test_copies_make_no_header(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfgjpvxz") + rng.choice("aeo") for _ in range(4))
    line = lambda: " ".join(word() for _ in range(6))
    head = "BOLETIM DA REDE – 2014"
    base = [(r, k, f"{r}_s{k:04d}", f"{line()}\n{line()}" + f"\n{head}" * (k % 4 == 0) + f"\n{line()}") for r in ("r", "q") for k in range(1, 41)]
    hot = [line() for _ in range(4)]
    exact = [("r", k, f"r_s1{k:03d}", "\n".join(hot)) for k in range(60)]
    revised = []
    for k in range(200):
        words = [x.split() for x in hot]
        for x in rng.sample(words, 2):
            x[rng.randrange(6)] = word()
        revised.append(("q", k, f"q_s1{k:03d}", "\n".join(" ".join(x) for x in words)))
    u = spark.createDataFrame(base + exact + revised, SCHEMA)
    assert {r["relatorio"]: [h["linha"] for h in r["cabecalhos"]] for r in D.headers(u).collect()} == {"r": [D.fold(head)], "q": [D.fold(head)]}
    got = {r["chave"]: r for r in D.repaired(u, D.Damage(u)).collect()}
    assert all(not got[c]["defeitos"] and got[c]["texto_limpo"] == t.replace("\n", " ") for _, _, c, t in exact + revised)
    assert all(got[c]["defeitos"] == ["cabecalho"] for _, _, c, t in base if head in t)


def test_copies_make_no_word(spark):
    right = [("r", 3, f"r_s{k:04d}", f"caso {k} da unidade de difusão") for k in range(60)]
    misread = [("r", 3, f"r_s{k}", "uma unidacle de difiisão") for k in range(1000, 1030) for _ in range(25)]
    u = spark.createDataFrame(right + misread, SCHEMA)
    got = {(r["texto_limpo"], *r["defeitos"]) for r in D.repaired(u, D.Damage(u)).collect()}
    assert got == {(t,) for _, _, _, t in right} | {("uma unidade de difusão", "caractere")}


def test_breaks():
    j = lambda lexicon: D.join_lines("o guarda-\nchuva preto", 3, 45, {}, lexicon)[0]
    assert j({}) == "o guardachuva preto" and j({"guarda\nchuva": "guarda-chuva"}) == "o guarda-chuva preto"
    assert D.breaks_of(["o guarda-", "BOLETIM 3", "chuva, preto", "fim"]) == {"guarda\nboletim", "guarda\nchuva", "guarda\nfim"}


def test_vocabulary_decides_hyphens(spark):
    rows = [("r", 1, "a", "um guarda-chuva e a suscetibilidade"), ("r", 1, "b", "o guarda-\nchuva"), ("r", 1, "c", "a suscet-\nibilidade"), ("r", 1, "d", "o guarda-\n• 1 •\nchuva")]
    u = spark.createDataFrame(rows, SCHEMA)
    damage = D.Damage(u)
    for limit in (None, 0):
        got = {r["chave"]: r["texto_limpo"] for r in D.repaired(u, damage, broadcast_limit=limit).collect()}
        assert got == {"a": rows[0][3], "b": "o guarda-chuva", "c": "a suscetibilidade", "d": "o guarda-chuva"}
