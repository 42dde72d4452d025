"""A mix of sources in target shares (problem 9).

Method: time-varying curriculum. Each source has a schedule of its weight over training, here a start
and an end weight that average to its target share; the schedule is integrated to a cumulative token
demand, and inverted at the middle of every document's run of tokens to give the document's position.
Documents are range-sorted by position. A small source is repeated, each pass in an order of its own, up
to its cap; what it can't reach is reported.

Only sums by source, as many as the target table has rows, are handled apart from the documents. Running
sums within a source are taken in blocks side by side, so that a source with a third of all rows is
spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Running sums within a pass of a source are taken in blocks of about so many documents, side by side.
BLOCK_ITEMS = 250_000
#: A source starts with its weight times 1 + TILT or 1 - TILT, and ends with the other, by the parity of its hash.
TILT = 0.25


def source_totals(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: ``source, peso_alvo, max_repeticoes, documentos, tokens, total``.

    ``total`` is the tokens of all documents, those of no or another source included. Targets without a
    name are left out; several rows of one source add up in weight and take the greatest cap.
    """
    goals = targets.where("source is not null").groupBy("source").agg(F.sum("peso_alvo").alias("peso_alvo"), F.max("max_repeticoes").alias("max_repeticoes"))
    sums = sized.groupBy("source").agg(F.count("*").alias("documentos"), F.sum("tokens").alias("tokens"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    own = goals.join(sums, "source", "left").select("source", "peso_alvo", "max_repeticoes", F.coalesce("documentos", F.lit(0)).alias("documentos"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return own.join(F.broadcast(total))


def shares(totals: DataFrame) -> DataFrame:
    """Per source what it is asked for and gives: ``source, peso_alvo, pedido, usado, repeticoes, parcela, alcancado``."""
    asked = F.col("peso_alvo") * F.col("total")
    most = (F.col("max_repeticoes") * F.col("tokens")).cast("double")
    used = totals.withColumn("pedido", asked).withColumn("usado", F.least(asked, most)).withColumn("alcancado", most >= asked)
    passes = F.when(F.col("tokens") > 0, F.ceil(F.col("usado") / F.col("tokens"))).otherwise(0).cast("int")
    return used.withColumn("repeticoes", passes).withColumn("parcela", F.col("usado") / F.sum("usado").over(Window.partitionBy(F.lit(1))))


def cumulative(tokens: Column, source: list[str], order: list[str]) -> tuple[Column, Column]:
    inner = Window.partitionBy(*source, "bloco").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(tokens).over(inner), inner


def position(done: Column, share: Column, tilt: Column) -> Column:
    """Where in training, from 0 to 1, a source has given the part ``done`` of its tokens.

    The weight at time t is proportional to 1 + tilt (1 - 2 t); its integral is t + tilt (t - t²), which
    is inverted here.
    """
    b = 1 + tilt
    return F.when(F.abs(tilt) < 1e-9, done).otherwise((b - F.sqrt(b * b - 4 * tilt * done)) / (2 * tilt))


def mix(sized: DataFrame, totals: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``posicao, key, source, passagem, tokens``: the mix in training order.

    ``sized``: ``key, source, tokens``; ``totals``: its ``source_totals``. A source's passes take its documents whole, in an order of their
    own, until its demand is met: the document that reaches the demand is the last, so a source gives its
    demand up to one document. Sources without target or document, and documents without tokens, don't
    take part.
    """
    most = totals.agg(F.max("documentos")).first()[0] or 1
    blocks = 1 << (-(-most // BLOCK_ITEMS) - 1).bit_length()
    goals = shares(totals).where("usado > 0").select("source", F.col("usado").alias("pedido"), "repeticoes", F.col("tokens").alias("fonte_tokens"))
    live = sized.where("tokens > 0").join(goals, "source")
    copies = live.withColumn("passagem", F.explode(F.sequence(F.lit(1), F.col("repeticoes"))))
    keyed = copies.withColumn("sorte", F.xxhash64(F.lit(seed), "passagem", key)).withColumn("bloco", (F.shiftrightunsigned("sorte", 65 - blocks.bit_length()).cast("int") if blocks > 1 else F.lit(0)))
    within, _ = cumulative(F.col("tokens"), ["source", "passagem"], ["sorte", key])
    sums = keyed.groupBy("source", "passagem", "bloco").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source", "passagem").orderBy("bloco").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("antes", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    run = keyed.join(offsets, ["source", "passagem", "bloco"]).withColumn("fim", (F.col("passagem") - 1) * F.col("fonte_tokens") + F.col("antes") + within)
    used = run.where(F.col("fim") - F.col("tokens") < F.col("pedido"))
    done = F.least(F.lit(1.0), (F.col("fim") - F.col("tokens") / 2) / F.col("pedido"))
    tilt = F.when(F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(2)) == 0, TILT).otherwise(-TILT)
    placed = used.withColumn("posicao", position(done, F.lit(1.0), tilt))
    return placed.select("posicao", key, "source", "passagem", "tokens").orderBy("posicao", key, "passagem")


def reached(mixed: DataFrame, totals: DataFrame) -> DataFrame:
    """Per source what the mix holds of it: ``source, pedido, usado, passagens, de, ate``; 0 tokens where it has none.

    ``de`` and ``ate`` are its first and last position in training.
    """
    own = mixed.groupBy("source").agg(F.sum("tokens").alias("usado"), F.max("passagem").alias("passagens"), F.min("posicao").alias("de"), F.max("posicao").alias("ate"))
    asked = totals.select("source", (F.col("peso_alvo") * F.col("total")).alias("pedido"))
    return asked.join(own, "source", "left").withColumns({"usado": F.coalesce("usado", F.lit(0)), "passagens": F.coalesce("passagens", F.lit(0))})


def left_short(mixed: DataFrame, totals: DataFrame) -> DataFrame:
    """The sources of which the mix holds less than their weight asks for, all their passes used: ``source``."""
    return reached(mixed, totals).where("usado < pedido").select("source")


def violations(mixed: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """One row of counts that are 0 in a right mix: sources used too often, more than a document over their demand, or short though they need not be; documents repeated in a pass; positions outside 0 to 1."""
    rows = mixed.groupBy("source").agg(F.sum("tokens").alias("usado"), F.max("tokens").alias("maior"), F.max("passagem").alias("passagens"), F.count_if(~F.col("posicao").between(0, 1)).alias("fora"), (F.count("*") - F.count_distinct(key, "passagem")).alias("repetidos"))
    both = shares(totals).withColumnRenamed("usado", "podia").join(rows, "source", "left").fillna(0)
    return both.agg(F.count_if(F.expr("passagens > max_repeticoes")).alias("demais"), F.count_if(F.expr("usado >= podia + maior and usado > 0")).alias("acima"), F.count_if(F.expr("usado < floor(podia)")).alias("abaixo"), F.sum("fora").alias("fora"), F.sum("repetidos").alias("repetidos"))
