"""The queries of problem 3 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folhetim.operators.packed import ARROWS, source_delimiters, type_pattern, unpack_cells
from folhetim.session import table

FIELDS = ["entidades_sugeridas", "entidades_corrigidas"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack_cells(table(spark, d, "annotation_tabelas"), "linha", FIELDS, ["anotador"])


def p3_delimiters(spark: SparkSession, d: str) -> DataFrame:
    return source_delimiters(table(spark, d, "annotation_tabelas"), ["anotador"], "entidades_corrigidas").select("anotador", "delimitador", "celulas", "posto")


def _sql() -> str:
    anchor = rf"{ARROWS}\s*{type_pattern()}"
    junk = r"[\s;|,/•]"
    return rf"""
    WITH c AS (
      SELECT linha, 'entidades_sugeridas' AS campo, entidades_sugeridas AS x FROM annotation_tabelas
      UNION ALL SELECT linha, 'entidades_corrigidas', entidades_corrigidas FROM annotation_tabelas),
    p AS (SELECT linha, campo, unnest(string_split(regexp_replace(x, '(?i)({anchor})\s*[;|,/•\n\t]{junk}*', '\1' || chr(30), 'g'), chr(30))) AS e,
                 generate_subscripts(string_split(regexp_replace(x, '(?i)({anchor})\s*[;|,/•\n\t]{junk}*', '\1' || chr(30), 'g'), chr(30)), 1) AS i
          FROM c WHERE x IS NOT NULL),
    q AS (SELECT linha, campo, i, regexp_replace(e, '^{junk}+|{junk}+$', '', 'g') AS e FROM p),
    r AS (SELECT linha, campo, i,
                 regexp_replace(regexp_replace(e, '(?is)\s*{anchor}\s*$', ''), '^\s+|\s+$', '', 'g') AS m,
                 upper(regexp_replace(regexp_extract(e, '(?is){ARROWS}\s*({type_pattern()})\s*$', 1), '[\s-]', '_', 'g')) AS tipo FROM q),
    s AS (SELECT linha, campo, i, tipo,
                 CASE WHEN length(m) > 2 AND m LIKE '"%"' THEN replace(trim(m[2:-2]), '""', '"')
                      WHEN length(m) > 2 AND m LIKE '''%''' THEN replace(trim(m[2:-2]), '''''', '''') ELSE m END AS mencao FROM r)
    SELECT linha, campo, CAST(row_number() OVER (PARTITION BY linha, campo ORDER BY i) AS INTEGER) AS posicao, mencao, tipo
    FROM s WHERE tipo <> '' AND mencao <> ''
    """


def queries() -> dict:
    return {"p3_found": p3_found, "p3_delimiters": p3_delimiters}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _sql()}
