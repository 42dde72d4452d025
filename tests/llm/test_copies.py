"""Problems 1 and 6 against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folhetim.llm import components, descan, nearcopies, overlap, wordsets
from folhetim.llm.spread import Workspace

RECORD = wordsets.RECORD + ", faixas binary"


def record(key, text):
    bag = wordsets.bag(text)
    return tuple(wordsets.records_of([key], bag, np.array([len(bag)]), 1, nearcopies.min_max_bands).to_pylist()[0].values())


def texts(seed=1, families=25, hot=120):
    rng = random.Random(seed)
    vocabulary = [f"p{i}" for i in range(600)]
    out = {}
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(12, 40))]
        for c in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, len(copy) // 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rng.shuffle(copy)
            out[f"f{f:02d}_{c}"] = " ".join(copy)
    base = [rng.choice(vocabulary) for _ in range(30)]
    for c in range(hot):  # one family with many different copies, and as many equal ones
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(30)] = rng.choice(vocabulary)
        out[f"h{c:03d}"] = " ".join(copy)
        out[f"i{c:03d}"] = " ".join(base)
    return out


def brute(rows):
    keys, parent = list(rows), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    bags = {k: set(wordsets.bag(t).tolist()) for k, t in rows.items()}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if 5 * len(bags[a] & bags[b]) >= 4 * max(len(bags[a]), len(bags[b])):
                parent[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), set()).add(k)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_words():
    assert wordsets.words('«Um» dois, – (TRÊS) 4%; m² "1ª" ...') == ["um", "dois", "três", "4", "m²", "1ª"]
    bag = wordsets.bag("a a b").tolist()
    assert len(bag) == 3 and len(set(bag)) == 3 and bag == wordsets.bag("b A, a").tolist()
    assert wordsets.bag("").tolist() == [] and wordsets.bag("... —").tolist() == []
    text = "«Um» dois, 3.048 (12%) a-b c/d PR58309 1ª m² ≥ 5; x"
    assert len(wordsets.bag(text)) == len(wordsets.words(text))


@pytest.mark.parametrize("paired", [50, 5])
def test_groups(spark, paired):
    rows = texts()
    df = spark.createDataFrame([record(k, t) for k, t in rows.items()] + [record("h000", rows["h000"])], RECORD)
    got = {}
    for r in nearcopies.grouped(df, paired=paired).collect():
        got.setdefault(r["classe"], set()).add(r["chave"])
        assert r["exemplares"] >= 2
    assert {frozenset(g) for g in got.values()} == brute(rows)
    assert all(min(g) == c for c, g in got.items())


def test_no_rows(spark):
    assert nearcopies.grouped(spark.createDataFrame([], RECORD)).count() == 0


@pytest.mark.parametrize("paired", [50, 5])
def test_splits(spark, paired):
    rows = texts(2)
    rng = random.Random(3)
    assigned = [(k, rng.choice(["treino", "validacao", "teste", None, "outra"])) for k in rows if rng.random() < 0.8] + [(None, "teste"), ("sem_texto", "teste"), ("sem_texto", "treino"), ("f00_0", "teste"), ("f00_0", "teste")]
    df = spark.createDataFrame([record(k, t) for k, t in rows.items()], RECORD)
    got = {tuple(r) for r in overlap.cross_split(df, spark.createDataFrame(assigned, "chave string, particao string"), paired=paired).select("chave", "particao").collect()}
    training = {k for k, p in assigned if p == "treino"}
    reached = set(training)
    for g in brute(rows):
        if g & training:
            reached |= g
    assert got == {(k, p) for k, p in assigned if p in ("validacao", "teste") and k in reached}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (3, 2)]
    got = {r["no"]: r["classe"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shuffled_rows(spark):
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("paired, held", [(50, 250_000), (5, 20)])
def test_bands_travel_packed(spark, monkeypatch, paired, held):
    monkeypatch.setattr(nearcopies, "SHARD_MEMBERS", held)
    rows = texts(4, families=200, hot=30)
    different = {record("", t)[1]: record("", t) for t in rows.values()}
    nodes = [(no, *r) for no, r in enumerate(different.values())]
    space = Workspace(spark)
    df = space.write(spark.createDataFrame(nodes, "no long, " + RECORD))
    bags = {r[0]: set(np.frombuffer(r[8], np.int64).tolist()) for r in nodes}
    bands = {r[0]: set(np.frombuffer(r[9], np.int64).tolist()) for r in nodes}
    linked = {(a, b) for a in bags for b in bags if a < b and bands[a] & bands[b] and 5 * len(bags[a] & bags[b]) >= 4 * max(len(bags[a]), len(bags[b]))}
    before = shuffled_rows(spark)
    pairs, large = nearcopies.band_pairs(df, space, 0.8, paired)
    if held > 1000:
        assert shuffled_rows(spark) - before < 4 * len(nodes)  # of 16 bands each, and their pairs
    pairs = [tuple(r) for r in pairs.collect()]
    members = {}
    for f, no in large.collect():
        members.setdefault(f, []).append(no)
    sizes = {}
    for no, fs in bands.items():
        for f in fs:
            sizes.setdefault(f, []).append(no)
    assert {f: sorted(m) for f, m in members.items()} == {f: sorted(m) for f, m in sizes.items() if len(m) > paired}
    in_few = {(a, b) for m in sizes.values() if len(m) <= paired for a in m for b in m if a < b}
    assert len(pairs) == len(set(pairs)) and linked & in_few <= set(pairs) <= in_few


def test_repair_of_arrays():
    texts = ["situação", "p1ano  Αno", "", "época", "a b\nc"]
    assert descan.plain_texts(pa.array(texts)).to_pylist() == [descan.plain(t) for t in texts]
    assert descan.plain_texts(pa.array([], pa.string())).to_pylist() == []
    fixer = descan.Fixer({"sorotlpo": "sorotipo"}, True)
    text = "sorotlpo, ab1cd x@yz (%5%) a-b a²b --- ab1cd"
    want = wordsets.bag("sorotipo ablcd xayz 5 a-b a²b ablcd")
    assert wordsets.bags_of([text, "", text], fixer)[0].tolist() == [*want.tolist(), *want.tolist()]
