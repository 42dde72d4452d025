"""Record types of the corpus and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The eight entity types, in the order of the tag set.
ENTITY_TYPES = (
    "PATOGENO",
    "SOROTIPO",
    "FAIXA_ETARIA",
    "LOCAL",
    "PERIODO_TEMPORAL",
    "METODO_LAB",
    "METRICA_EPI",
    "MANIFESTACAO_CLINICA",
)

SPAN = T.StructType([T.StructField("texto", T.StringType()), T.StructField("tipo", T.StringType())])

TEXT_UNIT = T.StructType(
    [
        T.StructField("relatorio", T.StringType()),
        T.StructField("pagina", T.IntegerType()),
        T.StructField("sentenca_id", T.StringType()),
        T.StructField("texto", T.StringType()),
    ]
)

TABLE_UNIT = T.StructType([*TEXT_UNIT.fields, T.StructField("tipo", T.StringType())])

ANNOTATED_UNIT = T.StructType(
    [
        *TABLE_UNIT.fields,
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("bio_tags", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


def bio_labels() -> list[str]:
    """``O`` and the B-/I- labels, in tag-set order, so that label ids never vary."""
    return ["O", *(f"{p}-{t}" for t in ENTITY_TYPES for p in "BI")]


def tagset(spark: SparkSession, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """One row per entity type: ``ordem, tipo``."""
    return spark.createDataFrame(list(enumerate(types)), "ordem int, tipo string")
