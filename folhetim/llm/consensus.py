"""Consensus of several annotators (problem 2).

Method: confidence-aware truth discovery. A source's weight is the lower chi-squared bound of its degrees
of freedom over the sum of its errors, that is, an upper bound on its error variance: a source of few
answers gets little weight, however right they seem. Weighted votes and weights are worked out by turns.

An annotator is two sources, for answers written and for suggestions accepted. Each turn is two grouped
sums over the votes; only the weights, a row per source, go back into the join, which Spark broadcasts
while they are few. A unit's votes are as many as its annotators times its mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folhetim.operators.packed import unpack_cells
from folhetim.session import checkpointed

TURNS = 4
#: z of the 2.5 % quantile.
Z = -1.959964
# Status that gives no answer.
NO_ANSWER = ("skip", "ignorar", "pendente", "erro")


def chi_squared(n: Column, z: float = Z) -> Column:
    """The quantile of the chi-squared distribution at ``z``, by Wilson and Hilferty's approximation."""
    c = 2 / (9 * n)
    return n * F.pow(F.greatest(1 - c + z * F.sqrt(c), F.lit(0.1)), F.lit(3.0))


def spelled(mention: Column) -> Column:
    """A mention in lower case, trimmed, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(mention), r"(?U)\s+", " "))


def answers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The annotators' answers: ``id, fonte, anotador``, and what they list: ``id, fonte, mencao, tipo``.

    An annotator's last answer for a unit counts (by time, then by ``linha``); re-exported rows change
    nothing. A mention that one answer lists twice has its first type. Rows without id or annotator are
    left out.
    """
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    fixed = F.col("entidades_corrigidas")
    nothing = fixed.rlike(r"(?i)^\s*\(?\s*nenhuma\s*\)?\s*$")
    accepts = fixed.isNull() | F.trim(fixed).isin("") | (F.lower(F.trim(fixed)) == "ok")
    valid = rows.where(~status.isin(*NO_ANSWER) & F.col("id").isNotNull() & F.col("anotador").isNotNull())
    last = Window.partitionBy("id", "anotador").orderBy(F.desc_nulls_last("revisado_em"), F.desc("linha"))
    own = valid.select("id", "anotador", "linha", "revisado_em", F.when(accepts, F.lit("aceita")).when(nothing, F.lit("nenhuma")).otherwise(F.lit("escreve")).alias("modo"))
    own = own.withColumn("k", F.row_number().over(last)).where("k = 1").withColumn("fonte", F.concat_ws("/", "anotador", F.when(F.col("modo") == "aceita", F.lit("aceita")).otherwise(F.lit("escreve"))))
    own = checkpointed(own.select("id", "fonte", "anotador", "linha", "modo"))
    listed = unpack_cells(rows, "linha", ["entidades_sugeridas", "entidades_corrigidas"], ["anotador"])
    field = F.when(F.col("modo") == "aceita", F.lit("entidades_sugeridas")).otherwise(F.lit("entidades_corrigidas"))
    claims = own.where("modo <> 'nenhuma'").withColumn("campo", field).join(listed, ["linha", "campo"])
    claims = claims.select("id", "fonte", spelled(F.col("mencao")).alias("mencao"), "tipo", "posicao").where("mencao <> ''")
    first = claims.groupBy("id", "fonte", "mencao").agg(F.min_by("tipo", "posicao").alias("tipo"))
    return own.select("id", "fonte", "anotador"), first


def votes(own: DataFrame, claims: DataFrame) -> DataFrame:
    """``id, mencao, fonte, tipo``: for every mention that anyone lists what each source of the unit says; null: not listed."""
    mentions = claims.select("id", "mencao").distinct()
    return mentions.join(own.select("id", "fonte"), "id").join(claims, ["id", "mencao", "fonte"], "left")


def verdict(sums: Column) -> Column:
    """The value of weighted votes, ``array<struct<tipo,w>>``: listed or not first, then the type; null: not to be listed.

    An even vote lists the mention; of types with even votes the first by name is taken.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["w"])
    listed, not_listed = F.filter(sums, lambda x: x["tipo"].isNotNull() & (x["w"] > 1e-9)), F.filter(sums, lambda x: x["tipo"].isNull())
    best = F.array_min(F.transform(listed, lambda x: F.struct(F.negative(F.round(x["w"], 9)).alias("w"), x["tipo"].alias("tipo"))))["tipo"]
    return F.when(F.round(total(listed) - total(not_listed), 9) >= 0, best)


def decide(cast: DataFrame, weights: DataFrame) -> DataFrame:
    """``id, mencao, somas, verdade`` by weighted vote; ``somas`` has at most a sum per type and one more."""
    sums = cast.join(weights.select("fonte", "peso"), "fonte").groupBy("id", "mencao", "tipo").agg(F.sum("peso").alias("w"))
    both = sums.groupBy("id", "mencao").agg(F.sort_array(F.collect_list(F.struct("tipo", "w"))).alias("somas"))
    return both.withColumn("verdade", verdict(F.col("somas")))


def weigh(cast: DataFrame, decided: DataFrame, weights: DataFrame) -> DataFrame:
    """``fonte, peso, votos, erros``: the sources' weights, 1 on average over the votes.

    A source is judged by the votes of the others, so that no source can confirm itself; mentions that
    no other source voted on don't count.
    """
    judged = cast.join(decided.select("id", "mencao", "somas"), ["id", "mencao"]).join(weights.select("fonte", "peso"), "fonte")
    without = F.transform("somas", lambda x: F.struct(x["tipo"].alias("tipo"), (x["w"] - F.when(x["tipo"].eqNullSafe(F.col("tipo")), F.col("peso")).otherwise(0.0)).alias("w")))
    rest = judged.select("fonte", "tipo", without.alias("outras")).where(F.exists("outras", lambda x: x["w"] > 1e-9))
    wrong = F.when(F.col("tipo").eqNullSafe(verdict(F.col("outras"))), 0.0).otherwise(1.0)
    per = rest.groupBy("fonte").agg(F.count("*").alias("votos"), F.sum(wrong).alias("erros"))
    raw = per.withColumn("bruto", chi_squared(F.col("votos").cast("double")) / (F.col("erros") + 0.5))
    mean = raw.agg((F.sum(F.col("bruto") * F.col("votos")) / F.sum("votos")).alias("media"))
    found = raw.join(F.broadcast(mean)).select("fonte", (F.col("bruto") / F.col("media")).alias("peso"), "votos", "erros")
    # a source that nobody else can judge keeps the weight it had
    lone = weights.select("fonte", "peso").join(per.select("fonte"), "fonte", "left_anti")
    return found.union(lone.select("fonte", "peso", F.lit(0).cast("long"), F.lit(0.0)))


def discover(rows: DataFrame, turns: int = TURNS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The answers, the votes, the truth and the weights after ``turns`` turns."""
    own, claims = answers(rows)
    cast = checkpointed(votes(own, claims))
    weights = own.select("fonte").distinct().withColumn("peso", F.lit(1.0))
    for _ in range(turns):
        weights = checkpointed(weigh(cast, decide(cast, weights), weights))
    truth = checkpointed(decide(cast, weights).select("id", "mencao", "verdade"))
    return own, cast, truth, weights


def consensus(rows: DataFrame) -> DataFrame:
    """``id, mencao, tipo``: the right mentions of each unit. No rows give no rows."""
    return discover(rows)[2].where("verdade is not null").select("id", "mencao", F.col("verdade").alias("tipo"))


def agreement(rows: DataFrame) -> DataFrame:
    """``id, anotadores, mencoes, concordancia``: the share of equal votes among all pairs of a unit's answers."""
    own, cast, _, _ = discover(rows, 0)
    same = cast.groupBy("id", "mencao", "tipo").agg(F.count("*").alias("k"))
    per = same.groupBy("id", "mencao").agg(F.sum("k").alias("n"), F.sum(F.expr("k * (k - 1)")).alias("pares"))
    unit = per.groupBy("id").agg(F.count("*").alias("mencoes"), F.max("n").alias("anotadores"), (F.sum("pares") / F.nullif(F.sum(F.expr("n * (n - 1)")), F.lit(0))).alias("concordancia"))
    return unit.select("id", "anotadores", "mencoes", "concordancia")


def reliability(rows: DataFrame) -> DataFrame:
    """``anotador, votos, erros, acerto, peso``: per annotator, over written and accepted answers."""
    own, _, _, weights = discover(rows)
    names = own.select("fonte", "anotador").distinct()
    per = weights.join(names, "fonte").groupBy("anotador").agg(F.sum("votos").alias("votos"), F.sum("erros").cast("long").alias("erros"), (F.sum(F.col("peso") * F.col("votos")) / F.nullif(F.sum("votos"), F.lit(0))).alias("peso"))
    return per.select("anotador", "votos", "erros", (1 - F.col("erros") / F.nullif(F.col("votos"), F.lit(0))).alias("acerto"), "peso")
