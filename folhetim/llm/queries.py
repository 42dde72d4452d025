"""The pN_ queries of this package, by name; each is applied to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folhetim.llm import canonical, consensus, descan, encodings, mixing, nearcopies, overlap, packing, quotas
from folhetim.llm.spread import Workspace, spread, written
from folhetim.llm.tokens import with_tokens
from folhetim.llm.wordsets import bags
from folhetim.session import table

LEAST_WORDS = 12


def text_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sireva_2014").select("relatorio", "pagina", F.col("sentenca_id").alias("chave"), "texto")


def table_units(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    return table(spark, d, "sireva_2020").select(none.cast("string").alias("relatorio"), none.cast("int").alias("pagina"), F.col("sentenca_id").alias("chave"), "texto")


# ---- p1


def records(spark: SparkSession, d: str, signature=None) -> DataFrame:
    """The bags of the texts of both tables, repaired; problems 1 and 6 form their groups over these."""
    units = text_units(spark, d)
    rows = table_units(spark, d)
    damage = descan.Damage(units, rows.select("texto"))
    return bags(spread(units).union(spread(rows)), damage, LEAST_WORDS, signature)


def record_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.grouped(records(spark, d, nearcopies.min_max_bands))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return record_groups(spark, d).select(F.col("chave").alias("sentenca_id"), "classe", "exemplares")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.pairs_within(record_groups(spark, d), F.col("chave").rlike("_t[0-9]+$"))


# ---- p2


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "annotation_tabelas"))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "annotation_tabelas"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "annotation_tabelas"))


# ---- p4


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    units = text_units(spark, d)
    return descan.defects(spread(units), descan.Damage(units)).withColumnRenamed("chave", "sentenca_id").distinct()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    units = text_units(spark, d)
    done = descan.repaired(spread(units), descan.Damage(units))
    return done.select(F.col("chave").alias("sentenca_id"), F.col("texto_limpo").alias("texto"), F.array_join("defeitos", ",").alias("defeitos")).distinct()


# ---- p5


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quotas.short_strata(p5_quotas(spark, d))


def p5_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    """Per draw and report what there is and what is lacking, by the flow."""
    return p5_quotas(spark, d).groupBy("seed", "relatorio").agg(F.sum("disponivel").alias("disponivel"), F.max("carencia").alias("carencia"))


def p5_violations(spark: SparkSession, d: str) -> DataFrame:
    """Counts that are 0 in right quotas and samples: cells asked for more than they have, draws above their size, units drawn twice, cells drawn off their quota."""
    q = written(p5_quotas(spark, d))
    drawn = quotas.sample(table(spark, d, "sireva_2014"), table(spark, d, "sampling_log"), q)
    cells = drawn.groupBy("seed", "relatorio", "classe").agg(F.count("*").alias("tirados"), F.count_distinct("sentenca_id").alias("unidades"))
    both = q.join(cells, ["seed", "relatorio", "classe"], "left").fillna(0, ["tirados", "unidades"])
    sizes = table(spark, d, "sampling_log").groupBy("seed").agg(F.max("n").alias("n"))
    over = q.groupBy("seed").agg(F.sum("quota").alias("s"), F.sum("minimo").alias("m")).join(sizes, "seed").agg(F.count_if(F.expr("s > greatest(n, m)")).alias("acima"))
    return both.agg(F.count_if(F.expr("quota > disponivel")).alias("demais"), F.count_if(F.expr("tirados <> quota")).alias("desvio"), F.count_if(F.expr("tirados <> unidades")).alias("repetidos")).join(F.broadcast(over))


def p5_quotas(spark: SparkSession, d: str) -> DataFrame:
    return quotas.cell_quotas(table(spark, d, "sireva_2014"), table(spark, d, "sampling_log"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return quotas.sample(table(spark, d, "sireva_2014"), table(spark, d, "sampling_log"))


# ---- p6


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    assigned = table(spark, d, "particoes").select(F.col("sentenca_id").alias("chave"), "particao")
    return overlap.cross_split(records(spark, d), assigned)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap(spark, d).select(F.col("chave").alias("sentenca_id"), "particao")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and report the units found, and how many units the split has of the report."""
    found = split_overlap(spark, d).withColumn("achado", F.lit(1))
    ids = table(spark, d, "sireva_2014").select("relatorio", F.col("sentenca_id").alias("chave")).distinct()
    assigned = table(spark, d, "particoes").select(F.col("sentenca_id").alias("chave"), "particao").where(F.col("particao").isin(*overlap.EVALUATION)).distinct()
    both = assigned.join(ids, "chave").join(found, ["chave", "particao"], "left")
    return both.groupBy("particao", "relatorio").agg(F.count("*").alias("unidades"), F.count("achado").alias("repetidas"))


# ---- p7


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    both = [spread(table(spark, d, t).select("sentenca_id", "texto")) for t in ("sireva_2014", "sireva_2020")]
    return canonical.variants(both[0].union(both[1]), "sentenca_id", "texto")


def p7_canonical(spark: SparkSession, d: str) -> DataFrame:
    both = [spread(table(spark, d, t).select("sentenca_id", "texto")) for t in ("sireva_2014", "sireva_2020")]
    return canonical.canonical(both[0].union(both[1]), "texto", "forma").select("sentenca_id", "forma").distinct()


# ---- p8


def sized_documents(spark: SparkSession, d: str) -> DataFrame:
    return with_tokens(spread(table(spark, d, "documents").select("doc_id", "source", "text"))).drop("text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.over_several(p8_containers(spark, d), "doc_id")


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    sized = written(sized_documents(spark, d))
    return packing.violations(sized, packing.pack(sized, "doc_id"), "doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(sized_documents(spark, d), "doc_id")


# ---- p9


def sized_and_totals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their tokens, counted once, and the sums by source; written tables."""
    space = Workspace(spark)
    sized = space.write(sized_documents(spark, d))
    return sized, space.write(mixing.source_totals(sized, table(spark, d, "mistura_alvo")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    sized, totals = sized_and_totals(spark, d)
    return mixing.left_short(written(mixing.mix(sized, totals, "doc_id")), totals)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(sized_and_totals(spark, d)[1])


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*sized_and_totals(spark, d), "doc_id")


def p9_violations(spark: SparkSession, d: str) -> DataFrame:
    sized, totals = sized_and_totals(spark, d)
    return mixing.violations(written(mixing.mix(sized, totals, "doc_id")), totals, "doc_id")


# ---- p10


def garbled(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restored(spread(table(spark, d, "documents").select("doc_id", "text", "lang")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(spark, d).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled(spark, d).select("doc_id", "restaurado", "cadeias", "perdido")


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express on whole tables."""
    return {
        "p5_found": """
            WITH a AS (SELECT relatorio, count(DISTINCT sentenca_id) AS n FROM sireva_2014 WHERE texto IS NOT NULL GROUP BY 1)
            SELECT DISTINCT s.seed, s.relatorio FROM sampling_log s LEFT JOIN a ON a.relatorio = s.relatorio
            WHERE coalesce(a.n, 0) < greatest(s.minimo, s.proporcao_alvo * s.n)
        """,
        "p5_shortfalls": """
            WITH a AS (SELECT relatorio, count(DISTINCT sentenca_id) AS n FROM sireva_2014 WHERE texto IS NOT NULL GROUP BY 1)
            SELECT s.seed, s.relatorio, CAST(coalesce(max(a.n), 0) AS BIGINT) AS disponivel, CAST(greatest(0, ceil(greatest(max(s.minimo), max(s.proporcao_alvo) * max(s.n))) - coalesce(max(a.n), 0)) AS BIGINT) AS carencia
            FROM sampling_log s LEFT JOIN a ON a.relatorio = s.relatorio GROUP BY 1, 2
        """,
        "p5_violations": "SELECT CAST(0 AS BIGINT) AS demais, CAST(0 AS BIGINT) AS desvio, CAST(0 AS BIGINT) AS repetidos, CAST(0 AS BIGINT) AS acima",
        "p8_violations": "SELECT CAST(0 AS BIGINT) AS acima, CAST(0 AS BIGINT) AS vazios, CAST(0 AS BIGINT) AS cortados, CAST(0 AS BIGINT) AS perdidos",
        "p9_violations": "SELECT CAST(0 AS BIGINT) AS demais, CAST(0 AS BIGINT) AS acima, CAST(0 AS BIGINT) AS abaixo, CAST(0 AS BIGINT) AS fora, CAST(0 AS BIGINT) AS repetidos",
        "p7_found": r"""
            SELECT DISTINCT sentenca_id FROM (SELECT sentenca_id, texto FROM sireva_2014 UNION ALL SELECT sentenca_id, texto FROM sireva_2020)
            WHERE regexp_matches(texto, '[\x{ad}\x{a0}\x{300}-\x{36f}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}\x{ff01}-\x{ffee}ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικρυА-ЯЅІЈа-яѕіјԁһ]')
        """.replace("\\\\", "\\"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
