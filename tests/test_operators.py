"""Units, scores, samples, tables, packed cells, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from folhetim.operators import gold, metrics, packed, sampling, tables, units
from folhetim.sources import corpus


def test_last_delivery_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 9, "n"), ("b", None, None)], "k string, t int, v string")
    assert sorted((r["k"], r["v"]) for r in units.last_delivery(df, "k", "t").collect()) == [("a", "y"), ("b", None)]
    assert units.last_delivery(df.limit(0), "k", "t").count() == 0


def test_units(spark):
    df = spark.createDataFrame([(1, "Primeira frase do texto. Curta.\n\nSegundo parágrafo do texto aqui.\n| a | b |\n| 1 | 2 |"), (2, None), (3, "")], "d int, t string")
    assert [(r["d"], r["posicao"], r["texto"]) for r in units.split_units(df, "d", "t").orderBy("d", "posicao").collect()] == [(1, 0, "Primeira frase do texto. Curta."), (1, 1, "Segundo parágrafo do texto aqui.")]


def test_allocation_vectors(spark):
    """The allocations that the reference's logs pin: 22 strata of 6,358 units, n = 180, at least 5."""
    known = {"sireva_2014": (249, 8), "sireva_2018": (238, 8), "sireva_2017": (230, 7), "ano10_n03": (113, 6), "ano08_n17": (85, 6)}
    rest = 6358 - sum(n for n, _ in known.values())
    others = [rest // 17 + (i < rest % 17) for i in range(17)]
    rows = [(k, n) for k, (n, _) in known.items()] + [(f"z{i:02d}", n) for i, n in enumerate(others)]
    out = {r["s"]: r["alocado"] for r in sampling.allocation(spark.createDataFrame(rows, "s string, n long"), "s", "n", 180, 5).collect()}
    assert sum(out.values()) == 180
    for k in ("sireva_2014", "sireva_2018", "sireva_2017"):
        assert abs(out[k] - known[k][1]) <= 1
    assert all(v >= 5 for v in out.values())


def test_half_even_split(spark):
    df = spark.createDataFrame([("a", 7, 10, 10), ("b", 9, 10, 10), ("c", 15, 10, 10), ("d", 8, 1, 10), ("e", 4, 0, 2)], "s string, alocado long, com_ha long, sem_ha long")
    out = {r["s"]: (r["com"], r["sem"]) for r in sampling.split_strata(df, "com_ha", "sem_ha").collect()}
    assert out == {"a": (4, 3), "b": (4, 5), "c": (8, 7), "d": (1, 7), "e": (0, 2)}


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "sentenca_id string, tokens array<string>, ga array<string>, gb array<string>")
    return df


def test_scores(spark):
    p = pairs(spark, [("u", ["a", "b", "c"], ["B-LOCAL", "I-LOCAL", "O"], ["B-LOCAL", "I-LOCAL", "B-PATOGENO"]), ("v", ["d"], ["B-SOROTIPO"], ["O"])])
    by = {r["entity"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.prf_by_type(p).collect()}
    assert by == {"LOCAL": (1.0, 1.0, 1.0, 1), "PATOGENO": (0.0, 0.0, 0.0, 0), "SOROTIPO": (0.0, 0.0, 0.0, 1)}
    avg = {r["entity"]: r["f1"] for r in metrics.prf_averages(p).collect()}
    assert avg == {"micro avg": 0.5, "macro avg": 0.3333, "weighted avg": 0.5}
    assert metrics.prf_averages(p.limit(0)).count() == 0


def test_kappa(spark):
    same = pairs(spark, [("u", ["a", "b"], ["O", "B-LOCAL"], ["O", "B-LOCAL"])])
    r = metrics.kappa_of(metrics.label_pairs(same)).first()
    assert (r["itens"], r["concordancia"], r["kappa"]) == (2, 100.0, 1.0)
    half = pairs(spark, [("u", list("abcd"), ["O", "O", "B-LOCAL", "B-LOCAL"], ["O", "B-LOCAL", "O", "B-LOCAL"])])
    assert metrics.kappa_of(metrics.label_pairs(half)).first()["kappa"] == 0.0
    only = pairs(spark, [("u", ["a"], ["O"], ["O"])])
    assert metrics.kappa_of(metrics.label_pairs(only)).first()["kappa"] == 1.0


def test_span_f1_counts_repeats_below_one(spark):
    p = pairs(spark, [("u", ["x", "y", "x"], ["B-LOCAL", "O", "B-LOCAL"], ["B-LOCAL", "O", "B-LOCAL"]), ("v", ["a"], ["O"], ["O"])])
    assert {r["sentenca_id"]: r["f1"] for r in metrics.span_f1_units(p).collect()} == {"u": 0.5, "v": 1.0}
    r = metrics.span_counts(p).first()
    assert (r["intersect"], r["total_a"], r["total_b"], r["f1"]) == (1, 1, 1, 1.0)


def test_aligned_truncates(spark):
    g = spark.createDataFrame([("u", ["a", "b"], ["O", "O"]), ("w", ["a"], ["O"])], "sentenca_id string, tokens array<string>, bio_tags array<string>")
    o = spark.createDataFrame([("u", ["O"])], "sentenca_id string, bio_tags array<string>")
    r = metrics.aligned(g, o).collect()
    assert len(r) == 1 and r[0]["ga"] == ["O"] and r[0]["descasada"]


def test_tables(spark):
    cells = [[None, "2014", None], ["Idade", "LCR n", " "], ["< 12 meses", "7", None], ["x", "y", ""], ["Total", "9", None], ["só", None, None]]
    df = spark.createDataFrame([("r", 1, 1, cells), ("r", 2, 2, [["a", "b"], ["c", "d"]]), ("r", 3, 3, []), ("r", 4, 4, [["1", "22"], ["333", "44"]])], "relatorio string, pagina int, tabela int, celulas array<array<string>>")
    caps = spark.createDataFrame([("r", 1, "Tabela 1. Casos")], "relatorio string, pagina int, legenda string")
    # no row of the first table is mostly numeric, so all are header; the last one has no header to name its values
    assert tables.table_rows(df, caps).count() == 0
    wide = [["", "LCR", "LCR"], ["Idade", "casos", "parte"], ["< 12 meses", "27", "63,6"], ["texto", "mais texto", "ainda"], ["Total", "29", "10"], ["50", "", ""]]
    df = spark.createDataFrame([("r", 1, 1, wide), ("q", 1, 1, wide)], "relatorio string, pagina int, tabela int, celulas array<array<string>>")
    out = sorted(r["texto"] for r in tables.table_rows(df, caps).collect())
    rows = ["Idade: < 12 meses | LCR casos: 27 | LCR parte: 63,6", "Idade: texto | LCR casos: mais texto | LCR parte: ainda"]
    assert out == rows + ["Tabela 1. Casos | " + r for r in rows]


def test_packed(spark):
    rows = [
        (1, "a", '"Sepse; bacteremia" → METODO_LAB; ; PCR -> metrica epi,"Teste ""rápido""": Local\n57,95=>METRICA_EPI;', None),
        (2, "a", "(nenhuma)", "ok"),
        (3, None, "", "'5-14 anos' → FAIXA_ETARIA / Cultura / PCR → METODO_LAB"),
        (3, None, "", "'5-14 anos' → FAIXA_ETARIA / Cultura / PCR → METODO_LAB"),
    ]
    df = spark.createDataFrame(rows, "linha long, fonte_0 string, s string, c string").withColumn("chave", F.lit(1)).withColumn("posicao", F.lit(2))
    out = sorted(tuple(r) for r in packed.unpack_cells(df, "linha", ["s", "c"], ["fonte_0"]).collect())
    assert out == sorted(
        [(1, "s", 1, "Sepse; bacteremia", "METODO_LAB"), (1, "s", 2, "PCR", "METRICA_EPI"), (1, "s", 3, 'Teste "rápido"', "LOCAL"), (1, "s", 4, "57,95", "METRICA_EPI")]
        + 2 * [(3, "c", 1, "5-14 anos", "FAIXA_ETARIA"), (3, "c", 2, "Cultura / PCR", "METODO_LAB")]
    )
    assert packed.unpack_cells(df.limit(0), "linha", ["s", "c"], ["fonte_0"]).count() == 0


def test_delimiters(spark):
    df = spark.createDataFrame([("x", "a → LOCAL | b → LOCAL | c → LOCAL"), ("x", "d → LOCAL | e; f → LOCAL"), ("y", "a → LOCAL, b → LOCAL")], "f string, c string")
    best = {r["f"]: r["delimitador"] for r in packed.source_delimiters(df, ["f"], "c").where("posto = 1").collect()}
    assert best == {"x": "barra_vertical", "y": "virgula"}


def test_gold(spark):
    rows = [("1", "Em Jacarei", "Corrigido ", [("Em", "LOCAL")], [("Jacarei", "LOCAL")]), ("2", "x", "ERRO", [], []), ("3", "", None, [], []), ("4", "Em Jacarei", "pendente", [("Em", "LOCAL")], []), ("5", "y", "skip", [], [])]
    df = spark.createDataFrame(rows, "id string, texto string, status string, spans_silver array<struct<texto:string,tipo:string>>, spans_correto array<struct<texto:string,tipo:string>>")
    assert {r["id"]: r["bio_tags"] for r in gold.build_gold(df).collect()} == {"1": ["O", "B-LOCAL"], "4": ["B-LOCAL", "O"]}
    c = gold.counters(df, "status", "texto").first().asDict()
    assert c == {"total": 5, "ok": 1, "corrigido": 1, "erro": 1, "pulado": 1, "pendente": 1, "sem_texto": 1}


def test_export(spark, tmp_path):
    tasks = [{"data": {"relatorio": "r", "pagina": 2, "sentenca_id": "r_s0001", "text": "39,1 casos"}, "annotations": [{"was_cancelled": True, "completed_by": 1, "result": []}, {"was_cancelled": False, "completed_by": 1, "result": [{"value": {"text": "39,1 casos 7", "labels": ["METRICA_EPI"]}}]}]}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(tasks), encoding="utf-8")
    r = gold.from_export(corpus.read_tasks(spark, str(path))).first()
    assert [tuple(x) for x in r["spans"]] == [("39,1", "METRICA_EPI"), ("7", "METRICA_EPI")] and r["pagina"] == 2


def test_files(spark, tmp_path):
    for name, text in (("a", "velho"), ("b", "novo")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"relatorio": "r", "pagina": 1, "sentenca_id": "r_s0001", "texto": text}) + "\n\n", encoding="utf-8")
    assert corpus.read_units_last_wins(spark, str(tmp_path)).first()["texto"] == "novo"
    corpus.write_units(corpus.read_units(spark, str(tmp_path)), str(tmp_path / "out"), by_report=True)
    assert corpus.read_units(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "r.csv").write_text('﻿id,texto,status\nx,"a, ""b""\nc",\n', encoding="utf-8")
    r = corpus.read_review(spark, str(tmp_path / "r.csv")).first()
    assert (r["id"], r["texto"], r["status"]) == ("x", 'a, "b"\nc', "")
    corpus.write_review(spark.createDataFrame([("1", 'q "z"')], "id string, t string"), str(tmp_path / "rev"))
    assert corpus.read_review(spark, str(tmp_path / "rev")).first()["t"] == 'q "z"'
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d.bin").write_bytes(b"um dois")
    (tmp_path / "docs" / "e.bin").write_bytes(b"\xff")
    extract = lambda b: [(1, b.decode())]
    got = {r["relatorio"]: (r["texto"], r["erro"] is None) for r in corpus.documents(spark, str(tmp_path / "docs"), extract).collect()}
    assert got == {"d": ("um dois", True), "e": (None, False)}


def test_stream(spark, tmp_path):
    from folhetim.streaming.units import deliveries_once

    rows = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-02 00:00:00"), ("b", "2025-01-01 00:00:00")], "sentenca_id string, t string").select("sentenca_id", F.to_timestamp("t").alias("carregado_em"))
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = deliveries_once(s).writeStream.format("memory").queryName("uma_vez").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("uma_vez").count() == 2


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_source_decides_the_cut(spark):
    cell = "a → LOCAL, b → LOCAL; c → LOCAL"
    df = spark.createDataFrame([(cell,)], "c string")
    cut = lambda *order: df.select(packed.cut_at(F.array("c"), F.lit(order[0])).alias("p")).first()["p"]
    assert cut(",") == ["a → LOCAL", "b → LOCAL; c → LOCAL"] and cut(";") == ["a → LOCAL, b → LOCAL", "c → LOCAL"]
    whole = lambda *names: df.select(packed.split_cell(F.col("c"), packed.endings(F.col("c")), F.array(*map(F.lit, names))).alias("p")).first()["p"]
    # a source whose delimiters are told to be others keeps what they don't cut
    assert whole("virgula", "ponto_e_virgula") == whole("ponto_e_virgula", "virgula") == ["a → LOCAL", "b → LOCAL", "c → LOCAL"]
    assert whole("virgula", "barra") == ["a → LOCAL", "b → LOCAL; c → LOCAL"]


def test_strict_pairing(spark):
    from folhetim.operators import metrics

    kinds = "sentenca_id string, tokens array<string>, bio_tags array<string>"
    a = spark.createDataFrame([("1", ["x"], ["O"]), ("2", ["x", "y"], ["O", "O"]), ("3", ["z"], ["O"])], kinds)
    b = spark.createDataFrame([("1", ["x"], ["O"]), ("2", ["x"], ["O"])], kinds)
    assert {tuple(r) for r in metrics.pairing_problems(a, b).collect()} == {("2", "tokens"), ("3", "ausente")}
    with pytest.raises(ValueError):
        metrics.strictly_paired(a, b)
    assert metrics.strictly_paired(a.limit(0), b).count() == 0
