"""Scores of predicted entities, and of agreement between annotators.

Units are paired by one join on their id; everything unit-local stays in arrays, and only entities, not
tokens, are exploded for the grouped counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folhetim.functions import tags as G


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def rounded(c: Column, places: int = 4) -> Column:
    return F.bround(c, places)


def aligned(gold: DataFrame, other: DataFrame, key: str = "sentenca_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Units of both sides, ``key, ga, gb`` cut to the shorter tag sequence, ``descasada`` where lengths differ."""
    a = gold.select(key, *keep, F.col("bio_tags").alias("a"), "tokens")
    b = other.select(key, F.col("bio_tags").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    return a.join(b, key).select(key, *keep, "tokens", F.slice("a", F.lit(1), n).alias("ga"), F.slice("b", F.lit(1), n).alias("gb"), (F.size("a") != F.size("b")).alias("descasada"))


def pairing_problems(gold: DataFrame, other: DataFrame, key: str = "sentenca_id") -> DataFrame:
    """``key, problema`` of gold units that can't be paired strictly: ``ausente`` from the other side, or with other ``tokens``."""
    b = other.select(key, F.col("tokens").alias("__b"))
    both = gold.select(key, "tokens").join(b, key, "left")
    kind = F.when(F.col("__b").isNull(), "ausente").when(~F.col("tokens").eqNullSafe(F.col("__b")), "tokens")
    return both.select(key, kind.alias("problema")).where("problema is not null")


def strictly_paired(gold: DataFrame, other: DataFrame, key: str = "sentenca_id") -> DataFrame:
    """``aligned`` of sides that have the same units of the same tokens; ValueError, with one of the problems, where they don't."""
    if bad := pairing_problems(gold, other, key).first():
        raise ValueError(f"{bad[key]!r}: {bad['problema']}")
    return aligned(gold, other, key)


def entity_rows(pairs: DataFrame, tags: str, *keep: str, lenient: bool = False) -> DataFrame:
    """``keep..., tipo, i, j`` for every entity of the tag sequences."""
    return pairs.select(*keep, F.explode(G.entity_spans(F.col(tags), lenient)).alias("x")).select(*keep, "x.tipo", "x.i", "x.j")


def outcome_counts(pairs: DataFrame, *by: str, lenient: bool = False) -> DataFrame:
    """``by..., tipo, tp, pred, suporte``: entities equal in type and boundaries, predicted, and true."""

    def kinds(x: Column, side: str) -> Column:
        return F.transform(x, lambda e: F.struct(e["tipo"].alias("tipo"), F.lit(side).alias("lado")))

    g, p = G.entity_spans(F.col("ga"), lenient), G.entity_spans(F.col("gb"), lenient)
    spans = pairs.select(*by, g.alias("g"), p.alias("p"))
    rows = spans.select(*by, F.explode(F.concat(kinds(F.col("g"), "g"), kinds(F.col("p"), "p"), kinds(F.array_intersect("g", "p"), "t"))).alias("x"))
    count = {k: F.count_if(F.col("x.lado") == k) for k in "tpg"}
    return rows.groupBy(*by, F.col("x.tipo").alias("tipo")).agg(count["t"].alias("tp"), count["p"].alias("pred"), count["g"].alias("suporte"))


def scores(counts: DataFrame, *by: str) -> DataFrame:
    """``by..., precision, recall, f1, support`` of outcome counts, in four places."""
    p, r = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("suporte"))
    raw = counts.withColumn("p", p).withColumn("r", r).withColumn("f", ratio(2 * F.col("tp"), F.col("pred") + F.col("suporte")))
    return raw.select(*by, rounded(F.col("p")).alias("precision"), rounded(F.col("r")).alias("recall"), rounded(F.col("f")).alias("f1"), F.col("suporte").alias("support"))


def prf_by_type(pairs: DataFrame) -> DataFrame:
    return scores(outcome_counts(pairs), "tipo").withColumnRenamed("tipo", "entity")


def prf_averages(pairs: DataFrame) -> DataFrame:
    """Micro, macro (over the types on either side) and weighted averages: ``entity, precision, recall, f1, support``."""
    c = outcome_counts(pairs)
    p, r, f = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("suporte")), ratio(2 * F.col("tp"), F.col("pred") + F.col("suporte"))
    per = c.withColumn("p", p).withColumn("r", r).withColumn("f", f)
    tot = per.agg(*[F.sum(x).alias(x) for x in ("tp", "pred", "suporte")], *[F.avg(x).alias(f"m{x}") for x in "prf"], *[ratio(F.sum(F.col(x) * F.col("suporte")), F.sum("suporte")).alias(f"w{x}") for x in "prf"]).where("tp is not null")

    def row(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(F.lit(name).alias("entity"), rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f).alias("f1"), F.col("suporte").alias("support"))

    micro = row("micro avg", ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("suporte")), ratio(2 * F.col("tp"), F.col("pred") + F.col("suporte")))
    rows = F.array(micro, row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")), row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))
    return tot.select(F.inline(rows))


def f1_by(pairs: DataFrame, by: str) -> DataFrame:
    """Micro F1 per group in three places."""
    sums = outcome_counts(pairs, by).groupBy(by).agg(*[F.sum(x).alias(x) for x in ("tp", "pred", "suporte")])
    return sums.select(by, F.bround(ratio(2 * F.col("tp"), F.col("pred") + F.col("suporte")), 3).alias("f1"), F.col("suporte").alias("support"))


def confusion(pairs: DataFrame, key: str = "sentenca_id") -> DataFrame:
    """``gold, pred, n``: for true entities the type predicted at the same boundaries, MISS where there is none."""
    g, p = entity_rows(pairs, "ga", key), entity_rows(pairs, "gb", key).withColumnRenamed("tipo", "pred")
    return g.join(p, [key, "i", "j"], "left").groupBy(F.col("tipo").alias("gold"), F.coalesce("pred", F.lit("MISS")).alias("pred")).agg(F.count("*").alias("n"))


def error_examples(pairs: DataFrame, texts: DataFrame, k: int = 5, key: str = "sentenca_id") -> DataFrame:
    """``erro, tipo, n, posto, sentenca_id, trecho``: errors per kind and type, with the first ``k`` examples.

    FN: a true entity whose boundaries are missed or of another type; FP: a predicted one whose
    boundaries are no true entity's, so a wrong type at right boundaries is no FP.
    """
    g, p = entity_rows(pairs, "ga", key), entity_rows(pairs, "gb", key)
    fn = g.join(p.withColumnRenamed("tipo", "pred"), [key, "i", "j"], "left").where(~F.col("tipo").eqNullSafe(F.col("pred"))).select(F.lit("FN").alias("erro"), "tipo", key, "i")
    fp = p.join(g.select(key, "i", "j"), [key, "i", "j"], "left_anti").select(F.lit("FP").alias("erro"), "tipo", key, "i")
    errors = fn.union(fp)
    counts = errors.groupBy("erro", "tipo").agg(F.count("*").alias("n"))
    first = errors.withColumn("posto", F.row_number().over(Window.partitionBy("erro", "tipo").orderBy(key, "i"))).where(F.col("posto") <= k)
    shown = first.join(counts, ["erro", "tipo"]).join(texts.select(key, F.substring("texto", 1, 80).alias("trecho")), key)
    return shown.select("erro", "tipo", "n", "posto", key, "trecho")


# ---- agreement


def kappa(agree: Column, pairs: Column, expected: Column) -> Column:
    """Cohen's kappa; 1 where nothing was compared or all is expected to agree."""
    po = agree / pairs
    return F.when((pairs == 0) | (expected >= 1), F.lit(1.0)).otherwise((po - expected) / (1 - expected))


def label_pairs(pairs: DataFrame, *by: str) -> DataFrame:
    """``by..., a, b, n``: how often labels meet, counted within units first."""
    return pairs.select(*by, F.explode(F.arrays_zip("ga", "gb")).alias("x")).groupBy(*by, F.col("x.ga").alias("a"), F.col("x.gb").alias("b")).agg(F.count("*").alias("n"))


def kappa_of(cells: DataFrame, *by: str) -> DataFrame:
    """``by..., itens, concordancia, kappa`` of counts ``a, b, n``: agreement in per cent, two places; kappa in four."""
    a = cells.groupBy(*by, F.col("a").alias("r")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(*by, F.col("b").alias("r")).agg(F.sum("n").alias("nb"))
    meet = a.join(b, [*by, "r"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("m"))
    tot = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("c"))
    both = tot.join(meet, list(by), "left") if by else tot.crossJoin(F.broadcast(meet))  # one row each
    e = F.coalesce("m", F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*by, F.col("n").alias("itens"), F.bround(100 * F.col("c") / F.col("n"), 2).alias("concordancia"), rounded(kappa(F.col("c"), F.col("n"), e)).alias("kappa"))


def kappa_by_type(pairs: DataFrame) -> DataFrame:
    """Kappa per type over the tokens that either side tags; a conflict counts under the first side's type."""
    kind = lambda c: F.when(c != "O", F.substring(c, 3, 100))
    cells = label_pairs(pairs).withColumn("tipo", F.coalesce(kind(F.col("a")), kind(F.col("b")))).where("tipo is not null")
    return kappa_of(cells, "tipo")


def _span_f1(pairs: DataFrame, key: str) -> DataFrame:
    mentions = lambda tags: F.transform(G.span_texts(F.col(tags), F.col("tokens")), lambda x: F.struct(F.lower(x["texto"]).alias("texto"), x["tipo"].alias("tipo")))
    m = pairs.select(key, mentions("ga").alias("a"), mentions("gb").alias("b"))
    total = F.size("a") + F.size("b")
    return m.select(key, F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect("a", "b")) / total).alias("f1"))


def span_f1_units(pairs: DataFrame, key: str = "sentenca_id") -> DataFrame:
    """``key, f1`` of both sides' mentions: common ones (as sets) over all listed; 1 where both list none."""
    return _span_f1(pairs, key).withColumn("f1", rounded(F.col("f1")))


def span_f1_mean(pairs: DataFrame, key: str = "sentenca_id") -> DataFrame:
    """``unidades, f1``: the mean of the units' scores."""
    return _span_f1(pairs, key).agg(F.count("*").alias("unidades"), rounded(F.avg("f1")).alias("f1"))


def token_agreement(pairs: DataFrame, key: str = "sentenca_id") -> DataFrame:
    """``key, concordancia``: the per cent of equal tags of each unit with tokens."""
    same = F.size(F.filter(F.arrays_zip("ga", "gb"), lambda x: x["ga"] == x["gb"]))
    return pairs.where(F.size("ga") > 0).select(key, F.bround(100 * same / F.size("ga"), 2).alias("concordancia"))


def span_counts(pairs: DataFrame) -> DataFrame:
    """``tipo, intersect, total_a, total_b, f1`` over the units' sets of mentions."""
    mentions = lambda tags: F.array_distinct(F.transform(G.span_texts(F.col(tags), F.col("tokens")), lambda x: F.struct(F.lower(x["texto"]).alias("texto"), x["tipo"].alias("tipo"))))
    m = pairs.select(mentions("ga").alias("a"), mentions("gb").alias("b"))
    side = lambda c, s: F.transform(c, lambda x: F.struct(x["tipo"].alias("tipo"), F.lit(s).alias("s")))
    rows = m.select(F.explode(F.concat(side(F.col("a"), "a"), side(F.col("b"), "b"), side(F.array_intersect("a", "b"), "i"))).alias("x"))
    n = {k: F.count_if(F.col("x.s") == k) for k in "iab"}
    per = rows.groupBy(F.col("x.tipo").alias("tipo")).agg(n["i"].alias("intersect"), n["a"].alias("total_a"), n["b"].alias("total_b"))
    return per.withColumn("f1", rounded(ratio(2 * F.col("intersect"), F.col("total_a") + F.col("total_b"))))
