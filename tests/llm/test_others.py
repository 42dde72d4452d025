"""Problems 2, 5, 8, 9 and 10."""

import random
from collections import Counter, defaultdict

from folhetim.llm import consensus, encodings, mixing, packing, quotas, tokens

REVIEW = "linha long, id string, texto string, entidades_sugeridas string, entidades_corrigidas string, status string, anotador string, revisado_em timestamp"


def test_consensus(spark):
    rng = random.Random(1)
    rows, truth, n = [], {}, 0
    names = {"bom1": 0.03, "bom2": 0.03, "medio": 0.12, "mau": 0.5}
    for u in range(60):
        right = {f"m{u}_{k}": rng.choice(["LOCAL", "SOROTIPO", "METODO_LAB"]) for k in range(5)}
        truth |= {(f"u{u}", m): t for m, t in right.items()}
        for a, bad in names.items():
            said = {m: (t if rng.random() > bad else "PATOGENO") for m, t in right.items() if rng.random() > bad / 2}
            n += 1
            rows.append((n, f"u{u}", "", "(nenhuma)", "; ".join(f"{m} → {t}" for m, t in said.items()) or "(nenhuma)", " OK ", a, None))
    rows.append((n + 1, *rows[0][1:]))  # exported again
    rows += [(n + 2, "u0", "", "zz → LOCAL", None, " Pendente", "mau", None), (n + 3, None, "", "zz → LOCAL", None, "ok", "mau", None), (n + 4, "u99", "", None, None, None, "bom1", None)]
    df = spark.createDataFrame(rows, REVIEW)
    got = {(r["id"], r["mencao"]): r["tipo"] for r in consensus.consensus(df).collect()}
    assert sum(got.get(k) == t for k, t in truth.items()) >= 0.97 * len(truth) and len(set(got) - set(truth)) == 0
    rel = {r["anotador"]: r["peso"] for r in consensus.reliability(df).collect()}
    assert rel["mau"] < rel["medio"] < max(rel["bom1"], rel["bom2"])
    agree = consensus.agreement(df).collect()
    assert all(r["concordancia"] is None or 0 <= r["concordancia"] <= 1 for r in agree)
    assert consensus.consensus(df.limit(0)).count() == 0


def test_accepting(spark):
    df = spark.createDataFrame([(1, "u", "", "A b → LOCAL", "ok", "ok", "x", None), (2, "u", "", "a  B → local", "", "ok", "y", None), (3, "u", "", "A b → LOCAL", "(nenhuma)", "corrigido", "z", None)], REVIEW)
    assert [tuple(r) for r in consensus.consensus(df).collect()] == [("u", "a b", "LOCAL")]


def best_possible(sizes, capacity):
    return -(-sum(sizes) // capacity)


def test_packing(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 100) for _ in range(700)] + [30] * 400 + [250, 100, 101, 0, 0]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    rows = packing.pack(df, "doc_id", 100).collect()
    load, seen = Counter(), defaultdict(int)
    for r in rows:
        load[r["recipiente"]] += r["tamanho"]
        seen[r["doc_id"]] += r["tamanho"]
        assert r["partes"] == 1 or sizes[r["doc_id"]] > 100
    assert max(load.values()) <= 100
    assert dict(seen) == {k: s for k, s in enumerate(sizes) if s}
    assert sorted(load) == list(range(len(load)))
    assert len(load) <= 1.05 * best_possible(sizes, 100)
    assert packing.pack(df.limit(0), "doc_id", 100).count() == 0
    placed = packing.pack(df, "doc_id", 100)
    assert {r[0] for r in packing.over_several(placed, "doc_id").collect()} == {k for k, s in enumerate(sizes) if s > 100}
    assert tuple(packing.violations(df, placed, "doc_id", 100).first()) == (0, 0, 0, 0)


def test_plan_of_large_items():
    # two large items at most in a container, matched from the largest down
    runs = packing.plan_containers({60: 2, 40: 3, 20: 1}, 100)
    packed = Counter()
    for n, sizes in runs:
        assert sum(sizes) <= 100 and sum(s > 33 for s in sizes) <= 2
        for s in sizes:
            packed[s] += n
    assert packed == {60: 2, 40: 3, 20: 1} and sum(n for n, _ in runs) == 3


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Olá mundo"), (2, None), (3, ""), (4, "ação " * 20_000)], "doc_id long, text string")
    e = tokens.encoding(tokens.VOCABULARY)
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(df).collect()}
    assert got == {1: len(e.encode_ordinary("Olá mundo")), 2: 0, 3: 0, 4: len(e.encode_ordinary("ação " * 20_000))}
    assert e.decode(e.encode_ordinary("β ≥ 5 µg")) == "β ≥ 5 µg"


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None, "sem"]), rng.randint(50, 150)) for i in range(600)] + [(1000, "a", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    goals = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.29, 2), ("vazio", 0.01, 4)], "source string, peso_alvo double, max_repeticoes int")
    totals = mixing.source_totals(sized, goals)
    own = Counter()
    for _, s, t in docs:
        own[s] += t
    total = sum(own.values())
    mixed = mixing.mix(sized, totals, "doc_id")
    assert {r[0] for r in mixing.left_short(mixed, totals).collect()} == {s for s, w, m in [("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.29, 2), ("vazio", 0.01, 4)] if m * own[s] < w * total}
    assert set(mixing.violations(mixed, totals, "doc_id").first()) == {0}
    rows = mixed.collect()
    used, times = Counter(), Counter()
    for r in rows:
        used[r["source"]] += r["tokens"]
        times[r["doc_id"]] += 1
    for s, w, m in [("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.29, 2)]:
        want = min(w * total, m * own[s])
        assert want <= used[s] < want + 151
    assert set(used) == {"a", "b", "c"}
    cap = {"a": 1, "b": 3, "c": 2}
    source = {i: s for i, s, _ in docs}
    assert all(n <= cap[source[i]] for i, n in times.items())
    places = [r["posicao"] for r in rows]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert mixing.mix(sized.limit(0), mixing.source_totals(sized.limit(0), goals), "doc_id").count() == 0


def test_rounding():
    rng = random.Random(1)
    for _ in range(50):
        parts = [rng.random() * 10 for _ in range(7)]
        out = quotas.rounded_at_random(parts, 40, rng)
        scale = 40 / sum(parts)
        assert sum(out) == 40 and all(abs(x - p * scale) < 1 + 1e-9 for x, p in zip(out, parts))


def test_quotas(spark):
    units = [(f"r{k % 3}", f"r{k % 3}_s{k:04d}", "x" * (10 + 7 * (k % 50))) for k in range(300)] + [("r0", "r0_s0000", "x" * 10), ("r1", "nulo", None), ("pouco", "p1", "texto"), ("pouco", "p1", "texto maior")]
    u = spark.createDataFrame(units, "relatorio string, sentenca_id string, texto string")
    plan = spark.createDataFrame([(1, 60, "r0", 0.5, 5), (1, 60, "r1", 0.4, 5), (1, 60, "pouco", 0.1, 2), (1, 60, "nada", 0.0, 1), (2, 40, "r2", 1.0, None), (3, None, "r1", None, None)], "seed int, n int, relatorio string, proporcao_alvo double, minimo int")
    assert {tuple(r) for r in quotas.short_strata(quotas.cell_quotas(u, plan)).collect()} == {(1, "pouco"), (1, "nada")}
    rows = quotas.cell_quotas(u, plan).collect()
    per, short = Counter(), {}
    for r in rows:
        assert 0 <= r["quota"] <= r["disponivel"]
        per[r["seed"], r["relatorio"]] += r["quota"]
        short[r["seed"], r["relatorio"]] = r["falta"]
    assert per[1, "pouco"] == 1 and per[1, "nada"] == 0 and short[1, "pouco"] >= 1 and short[1, "nada"] >= 1
    assert 29 <= per[1, "r0"] <= 31 and per[1, "r1"] >= 23 and per[2, "r2"] == 40
    s = quotas.sample(u, plan).collect()
    assert Counter((r["seed"], r["relatorio"]) for r in s) == {k: v for k, v in per.items() if v}
    assert len({(r["seed"], r["sentenca_id"]) for r in s}) == len(s)
    assert quotas.cell_quotas(u, plan.limit(0)).count() == 0


TEXT = "A vacinação de rotina cobriu 95,38% das crianças, com situação acentuada – conforme a nota nº 5 (≥ 60 anos). Não há relação."


def test_encodings(spark):
    clean = [(i, f"Até {i} casos, a investigação apontou redução da incidência em março; não há óbitos.\n{TEXT}", "pt") for i in range(40)]
    wrong = {
        100: TEXT.encode().decode("latin-1"),
        101: TEXT.encode().decode("mac_roman"),
        102: TEXT.encode().decode("cp850"),
        103: encodings_twice(TEXT),
        104: TEXT.replace("≥ ", "").encode("cp1252").decode("cp850"),
    }
    rows = clean + [(k, f"{TEXT}\n{t}", None if k == 101 else "pt") for k, t in wrong.items()]
    rows += [(210, "ver https://x.org/a?b=c e www.y.org/p?q", "pt")]
    rows += [(200, "situa��o", "pt"), (201, "l??quido e situa??o", "pt"), (202, None, "pt"), (203, "", None), (204, "RELAÇÃO À PENICILINA: CRIANÇAS – 2º", "pt")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in encodings.restored(df).collect()}
    assert set(got) == {*wrong, 200, 201}
    assert got[200]["perdido"] and got[201]["perdido"]
    for k in (100, 101, 102, 103):
        assert got[k]["restaurado"] == f"{TEXT}\n{TEXT}", k
    assert got[104]["restaurado"].split("\n")[1] == TEXT.replace("≥ ", "")
    assert encodings.restored(df.limit(0)).count() == 0


def encodings_twice(text):
    return text.encode().decode("latin-1").encode().decode("latin-1")


def test_runs_are_decoded_once(monkeypatch):
    calls = Counter()
    to_bytes = encodings.to_bytes

    def counted(run, codec):
        calls[run, codec] += 1
        return to_bytes(run, codec)

    monkeypatch.setattr(encodings, "to_bytes", counted)
    encodings.remembered.cache_clear()
    restorer = encodings.Restorer({"pt": TEXT.encode() * 20})
    wrong = "\n".join(f"{k}: {t}" for k, t in enumerate([TEXT.encode().decode("latin-1"), encodings_twice(TEXT), TEXT] * 30))
    right = "\n".join(f"{k}: {TEXT}" for k in range(90))
    assert restorer.document(wrong, "pt")[::2] == (right, False)
    assert max(calls.values()) <= 2  # read as either of two encodings
    long = "ж" * 40
    assert encodings.candidates(f"a {long} b")[f"a {long} b"] == () and encodings.undo(["a"], "windows", "utf-8") is None
