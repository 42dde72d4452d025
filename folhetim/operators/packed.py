"""Several values packed in one field (problem 3).

A cell such as ``PCR → METODO_LAB; "57,95" -> metrica_epi`` lists elements of a mention, an arrow and
a type. Which separator stands between elements differs by source and even within a cell, and the
separators also occur inside mentions.

Method: every candidate delimiter is scored on each cell by two figures. Piece-count consistency is
the share of the typed elements of the cell (but the last) that the delimiter follows; piece type
regularity is the share of the delimiter's occurrences that end such an element. The scores, averaged
over the cells of a source, rank the delimiters of the source. A cell is then cut at its source's best
delimiter, and where others end typed elements in it, at those too; an element keeps every delimiter that
it holds inside. As every element ends in a type, a cell that disagrees with its source loses nothing by
it. One regular expression finds what ends the elements; the only shuffle is the report by source.
"""

from __future__ import annotations

from functools import partial
from operator import eq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhetim.schema import ENTITY_TYPES

#: Candidate delimiters: name and the character.
DELIMITERS = {"ponto_e_virgula": ";", "barra_vertical": "|", "virgula": ",", "barra": "/", "marcador": "•", "linha": "\n", "tabulacao": "\t"}
ARROWS = r"(?:→|->|=>|:)"
MARK = "\u001e"


def type_pattern(types: tuple[str, ...] = ENTITY_TYPES) -> str:
    """A pattern for any type in any spelling of case and underscore."""
    return "(?:" + "|".join(t.replace("_", r"[\s_-]?") for t in types) + ")"


def escaped(delimiter: str) -> str:
    return {"|": r"\|", "\n": r"\n", "\t": r"\t"}.get(delimiter, delimiter)


def anchor_pattern(types: tuple[str, ...] = ENTITY_TYPES) -> str:
    """The end of a typed element: arrow and type."""
    return rf"{ARROWS}\s*{type_pattern(types)}"


def endings(cell: Column, types: tuple[str, ...] = ENTITY_TYPES) -> Column:
    """``array<string>``: what follows each typed element of the cell: a delimiter's character, or '' where none does."""
    return F.regexp_extract_all(cell, F.lit(rf"(?i){anchor_pattern(types)}[^\S\n\t]*([{''.join(map(escaped, DELIMITERS.values()))}]?)"), F.lit(1))


def delimiter_scores(cell: Column, ends: Column) -> Column:
    """``map<delimiter, score>`` of one cell and its ``endings``, in ``DELIMITERS`` order, from 0 to 1; null for a null cell."""
    scores = []
    for name, d in DELIMITERS.items():
        closed = F.size(F.filter(ends, partial(eq, d))).cast("double")
        there = F.length(cell) - F.length(F.translate(cell, d, ""))
        consistency = F.least(F.lit(1.0), closed / F.greatest(F.size(ends) - 1, F.lit(1)))
        scores += [F.lit(name), F.when(there > 0, consistency * closed / there).otherwise(F.lit(0.0))]
    return F.when(cell.isNotNull(), F.create_map(*scores))


JUNK = r"[\s;|,/•]"


def cut_at(pieces: Column, delimiter: Column, types: tuple[str, ...] = ENTITY_TYPES) -> Column:
    """Each piece cut where ``delimiter``, an escaped character, ends a typed element."""
    pattern = F.concat(F.lit(rf"(?i)({anchor_pattern(types)})[^\S\n\t]*["), delimiter, F.lit(rf"]{JUNK}*"))
    return F.flatten(F.transform(pieces, lambda p: F.split(F.regexp_replace(p, pattern, F.lit(f"$1{MARK}")), MARK)))


def split_cell(cell: Column, ends: Column, order: Column, types: tuple[str, ...] = ENTITY_TYPES) -> Column:
    """``array<string>``: the elements of a cell, trimmed, empty ones left out; an empty array for null.

    ``order``: the delimiters of the source, best first. The cell is cut at the first; where that leaves
    several typed elements in a piece, as the cell's ``endings`` tell, it is cut at all others that end
    an element in it as well.
    """
    chars = F.create_map(*[F.lit(x) for n, d in DELIMITERS.items() for x in (n, escaped(d))])
    signs = F.create_map(*[F.lit(x) for n, d in DELIMITERS.items() for x in (n, d)])
    first = F.element_at(order, 1)
    others = F.array_join(F.transform(F.filter(order, lambda n: (n != first) & F.array_contains(ends, signs[n])), lambda n: chars[n]), "")
    once = cut_at(F.array(cell), chars[first], types)
    pieces = F.when(others == "", once).otherwise(cut_at(once, others, types))
    cleaned = F.transform(pieces, lambda p: F.regexp_replace(p, rf"^{JUNK}+|{JUNK}+$", ""))
    return F.coalesce(F.filter(cleaned, lambda p: p != ""), F.array().cast("array<string>"))


def element_mention(element: Column, types: tuple[str, ...] = ENTITY_TYPES) -> Column:
    """The mention of an element as written, without the quotes and blanks around it; doubled quotes inside become one."""
    raw = F.regexp_replace(element, rf"(?is)\s*{anchor_pattern(types)}\s*$", "")
    raw = F.regexp_replace(raw, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2"), r"^\s+|\s+$", "")
    return F.when(raw.rlike(r"""(?s)^".+"$"""), F.replace(inner, F.lit('""'), F.lit('"'))).when(raw.rlike(r"""(?s)^'.+'$"""), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(raw)


def element_type(element: Column, types: tuple[str, ...] = ENTITY_TYPES) -> Column:
    """The type of an element, in upper case with underscores; '' where it has none."""
    return F.upper(F.regexp_replace(F.regexp_extract(element, rf"(?is){ARROWS}\s*({type_pattern(types)})\s*$", 1), r"[\s-]", "_"))


def ranked_delimiters(scored: DataFrame, source: list[str], scores: str) -> DataFrame:
    long = scored.select(*source, F.explode(scores).alias("delimitador", "p"))
    means = long.groupBy(*source, "delimitador").agg(F.count("*").alias("celulas"), F.avg("p").alias("pontos"))
    ranked = F.sort_array(F.collect_list(F.struct(F.negative("pontos").alias("n"), "delimitador", "celulas", "pontos")))
    per = means.groupBy(*source).agg(ranked.alias("r"))
    return per.select(*source, F.posexplode("r").alias("i", "x")).select(*source, "x.delimitador", "x.celulas", "x.pontos", (F.col("i") + 1).alias("posto"))


def source_delimiters(df: DataFrame, source: list[str], cell: str, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """Per source the delimiters with their mean score over the source's cells and their rank.

    Returns ``source..., delimitador, celulas, pontos, posto``. The scores are summed before the
    shuffle, so a source that holds most rows costs no more than others; an equal score ranks by name.
    """
    scored = df.where(F.col(cell).isNotNull()).select(*source, cell, endings(F.col(cell), types).alias("fins"))
    scored = scored.select(*source, delimiter_scores(F.col(cell), F.col("fins")).alias("pontos_celula"))
    return ranked_delimiters(scored, source, "pontos_celula")


def unpack_cells(df: DataFrame, key: str, fields: list[str], source: list[str] | None = None, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """One row per listed element of the packed ``fields``: ``key, campo, posicao, mencao, tipo``.

    ``posicao`` counts from 1 in the order of the cell, empty elements not counted. Null and empty cells
    and those without any typed element (``(nenhuma)``, ``ok``) give no rows; an element without a type
    is skipped together with its position. Repeated rows give repeated results; other columns of ``df``
    don't matter. ``source`` names the columns that tell who wrote the cell (none: one source per field).
    """
    own = [F.col(s).alias(f"fonte_{i}") for i, s in enumerate(source or [])]
    per = ["campo", *(f"fonte_{i}" for i in range(len(own)))]
    cells = df.select(F.col(key).alias("chave"), *own, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("campo", "celula"))
    # cells without a typed element list nothing
    cells = cells.where(F.col("celula").isNotNull()).withColumn("fins", endings(F.col("celula"), types)).where(F.size("fins") > 0)
    best = F.transform(F.sort_array(F.collect_list(F.struct("posto", "delimitador"))), lambda x: x["delimitador"])
    scored = cells.select(*per, delimiter_scores(F.col("celula"), F.col("fins")).alias("pontos"))
    orders = ranked_delimiters(scored, per, "pontos").groupBy(*[F.col(p).alias(f"o_{p}") for p in per]).agg(best.alias("ordem"))
    match = F.lit(True)
    for p in per:
        match &= F.col(p).eqNullSafe(F.col(f"o_{p}"))
    pieces = cells.join(orders, match).select("chave", "campo", F.explode(F.array(split_cell(F.col("celula"), F.col("fins"), F.col("ordem"), types))).alias("pecas"))
    elements = pieces.select("chave", "campo", F.transform("pecas", lambda e: F.struct(element_mention(e, types).alias("mencao"), element_type(e, types).alias("tipo"))).alias("es"))
    typed = elements.select("chave", "campo", F.posexplode(F.filter("es", lambda e: (e["tipo"] != "") & (e["mencao"] != ""))).alias("i", "e"))
    return typed.select(F.col("chave").alias(key), "campo", (F.col("i") + 1).cast("int").alias("posicao"), "e.mencao", "e.tipo")
