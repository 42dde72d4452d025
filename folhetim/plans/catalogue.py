"""The queries of the reference's operators on the driver's tables, each beside its SQL.

Text units are the last deliveries of ``sireva_2014``; two rule annotators stand for silver and gold
annotations (A is gold, B silver); table rows and their review cells come from ``annotation_tabelas``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folhetim.functions import tags as G
from folhetim.functions import text as T
from folhetim.operators import annotate, gold, locate, metrics, sampling, stats, units
from folhetim.schema import ENTITY_TYPES, tagset
from folhetim.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- frames

def text_units(spark: SparkSession, d: str) -> DataFrame:
    return units.last_delivery(table(spark, d, "sireva_2014").select("relatorio", "pagina", "sentenca_id", "texto", "carregado_em"), "sentenca_id", "carregado_em").where("texto is not null")


def gold_units(spark: SparkSession, d: str) -> DataFrame:
    return annotate.annotated(text_units(spark, d), rules=annotate.RULES_A)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Both annotators' tags of each unit, as ``metrics.aligned`` gives them.

    Both come from one scan here; ``metrics.aligned`` joins two tables of annotated units.
    """
    u = text_units(spark, d).withColumn("tokens", G.tokens(F.col("texto")))
    return u.select("sentenca_id", "relatorio", "texto", "tokens", annotate.rule_tags(F.col("tokens"), annotate.RULES_A).alias("ga"), annotate.rule_tags(F.col("tokens"), annotate.RULES_B).alias("gb"))


def review(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotation_tabelas")


# ---- the same in SQL

U = """u AS (SELECT relatorio, pagina, sentenca_id, texto FROM (
  SELECT *, row_number() OVER (PARTITION BY sentenca_id ORDER BY carregado_em DESC NULLS LAST, pagina DESC NULLS LAST, relatorio DESC NULLS LAST, texto DESC NULLS LAST) AS k
  FROM sireva_2014 WHERE sentenca_id IS NOT NULL) WHERE k = 1 AND texto IS NOT NULL)"""
TOK = rf"""{U}, tl AS (SELECT relatorio, sentenca_id, texto, regexp_extract_all(texto, '[^{T.BLANK}]+') AS ts FROM u),
t AS (SELECT relatorio, sentenca_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM tl)"""


def _case(rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(token, '{p}') THEN '{k}'" for p, k in rules) + " END"


TAGS = f"""{TOK}, k AS (SELECT *, {_case(annotate.RULES_A)} AS ka, {_case(annotate.RULES_B)} AS kb FROM t),
l AS (SELECT *, lag(ka) OVER w AS pa, lag(kb) OVER w AS pb FROM k WINDOW w AS (PARTITION BY sentenca_id ORDER BY pos)),
g AS (SELECT *, CASE WHEN ka IS NULL THEN 'O' WHEN ka = pa THEN 'I-' || ka ELSE 'B-' || ka END AS ta, CASE WHEN kb IS NULL THEN 'O' WHEN kb = pb THEN 'I-' || kb ELSE 'B-' || kb END AS tb FROM l)"""
# islands: a rule annotator's I- always continues an entity of its type
SPANS = f"""{TAGS}, ia AS (SELECT *, sum(CASE WHEN ta LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY sentenca_id ORDER BY pos) AS x, sum(CASE WHEN tb LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY sentenca_id ORDER BY pos) AS y FROM g),
sa AS (SELECT relatorio, sentenca_id, ka AS tipo, min(pos) AS i, max(pos) + 1 AS j, string_agg(token, ' ' ORDER BY pos) AS texto FROM ia WHERE ka IS NOT NULL GROUP BY relatorio, sentenca_id, ka, x),
sb AS (SELECT relatorio, sentenca_id, kb AS tipo, min(pos) AS i, max(pos) + 1 AS j, string_agg(token, ' ' ORDER BY pos) AS texto FROM ia WHERE kb IS NOT NULL GROUP BY relatorio, sentenca_id, kb, y)"""
OUTCOMES = f"""{SPANS}, oc AS (SELECT coalesce(a.tipo, b.tipo) AS tipo, coalesce(a.relatorio, b.relatorio) AS relatorio, count(*) FILTER (a.tipo IS NOT NULL AND b.tipo IS NOT NULL) AS tp,
  count(b.tipo) AS pred, count(a.tipo) AS suporte FROM sa a FULL JOIN sb b ON a.sentenca_id = b.sentenca_id AND a.tipo = b.tipo AND a.i = b.i AND a.j = b.j GROUP BY 1, 2),
o AS (SELECT tipo, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(pred) AS DOUBLE) AS pred, CAST(sum(suporte) AS DOUBLE) AS suporte FROM oc GROUP BY 1),
f AS (SELECT *, CASE WHEN pred = 0 THEN 0 ELSE tp / pred END AS p, CASE WHEN suporte = 0 THEN 0 ELSE tp / suporte END AS r, CASE WHEN pred + suporte = 0 THEN 0 ELSE 2 * tp / (pred + suporte) END AS f1 FROM o)"""


def r4(x: str, n: int = 4) -> str:
    return f"CAST(round_even({x}, {n}) AS DOUBLE)"


TYPES_SQL = "ts AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in ENTITY_TYPES) + "]) AS tipo)"


# ---- sources, units and text

@query(f"WITH {U} SELECT sentenca_id, relatorio, texto FROM u")
def last_wins_dedupe(spark, d):
    return text_units(spark, d).select("sentenca_id", "relatorio", "texto")


DOC_UNITS = r"""p AS (SELECT doc_id, source, unnest(list_filter(list_transform(string_split_regex(text, '\n{2,}'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '')) AS par FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, source, unnest(list_filter(list_transform(string_split(regexp_replace(par, '([.!?])\s{1,3}([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '')) AS frase FROM p)"""


def _paragraph_sentences(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", "source", F.explode(T.paragraphs(F.col("text"))).alias("par")).select("doc_id", "source", F.explode(T.sentences(F.col("par"))).alias("frase"))


@query(f"WITH {DOC_UNITS} SELECT source, count(*) AS frases, CAST(sum(len(regexp_extract_all(frase, '[^{T.BLANK}]+'))) AS BIGINT) AS tokens FROM s GROUP BY source")
def units_per_source(spark, d):
    return _paragraph_sentences(spark, d).groupBy("source").agg(F.count("*").alias("frases"), F.sum(F.size(G.tokens(F.col("frase")))).alias("tokens"))


@query(rf"WITH {DOC_UNITS} SELECT count(*) AS frases, count(*) FILTER (length(frase) >= 15 AND NOT regexp_matches(frase, '\.{{3,}}') AND regexp_matches(frase, '[{T.LETTER}]{{3,}}')) AS narrativas FROM s")
def narrative_filter(spark, d):
    return _paragraph_sentences(spark, d).agg(F.count("*").alias("frases"), F.count_if(T.is_narrative(F.col("frase"))).alias("narrativas"))


@query(r"""WITH p AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, par, row_number() OVER () AS pid FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\n{2,}'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '')) AS par FROM p)),
s AS (SELECT doc_id, pid, unnest(l) AS f, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, pid, list_filter(list_transform(string_split(regexp_replace(par, '([.!?])\s{1,3}([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '') AS l FROM q)),
g AS (SELECT *, sum(CASE WHEN i = 1 OR length(f) >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY i) AS gid FROM s),
m AS (SELECT doc_id, string_agg(f, ' ' ORDER BY i) AS frase FROM g GROUP BY doc_id, pid, gid)
SELECT doc_id, count(*) AS frases, CAST(max(length(frase)) AS INTEGER) AS maior FROM m GROUP BY doc_id""")
def merge_short_fragments(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    merged = docs.select("doc_id", F.explode(F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: T.fold_short(T.sentences(p))))).alias("frase"))
    return merged.groupBy("doc_id").agg(F.count("*").alias("frases"), F.max(F.length("frase")).alias("maior"))


@query("""WITH x AS (SELECT relatorio, sentenca_id, 'x' AS y FROM (SELECT DISTINCT relatorio, sentenca_id FROM sireva_2020))
SELECT sentenca_id AS origem, relatorio || '_t' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS sentenca_id FROM (SELECT *, row_number() OVER (PARTITION BY relatorio ORDER BY sentenca_id) AS n FROM x)""")
def unit_ids(spark, d):
    u = table(spark, d, "sireva_2020").select("relatorio", F.col("sentenca_id").alias("origem")).distinct()
    return units.numbered_units(u, "relatorio", "origem", kind="t").select("origem", "sentenca_id")


@query(rf"""WITH {TOK} SELECT sentenca_id FROM tl WHERE len(ts) BETWEEN 8 AND 60 AND NOT (texto = upper(texto) AND texto <> lower(texto)) AND len(list_filter(ts, lambda x: regexp_matches(x, '\p{{L}}'))) >= 0.5 * len(ts)""")
def quality_filter(spark, d):
    u = text_units(spark, d).withColumn("tokens", G.tokens(F.col("texto")))
    return u.where(T.good_length(F.col("tokens"), F.col("texto"))).select("sentenca_id")


@query(rf"""WITH c AS (SELECT sentenca_id, unnest(string_split(texto, '|')) AS c FROM (SELECT DISTINCT sentenca_id, texto FROM sireva_2020 WHERE texto IS NOT NULL))
SELECT sentenca_id, trim(regexp_replace(c, '[{T.BLANK}]+', ' ', 'g')) AS celula, count(*) AS n FROM c GROUP BY 1, 2""")
def clean_cells(spark, d):
    c = table(spark, d, "sireva_2020").where("texto is not null").select("sentenca_id", "texto").distinct().select("sentenca_id", F.explode(F.split("texto", r"\|")).alias("c"))
    return c.groupBy("sentenca_id", T.clean_cell(F.col("c")).alias("celula")).agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS linhas, count(*) FILTER (regexp_matches(x, '^\s*\|.*\|')) AS de_tabela, count(*) FILTER (regexp_matches(x, '^\s*\|.*\|') AND translate(trim(x), '|: -', '') = '') AS separadoras FROM l GROUP BY doc_id""")
def table_line_filter(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("linhas"), F.count_if(T.is_table_line(F.col("x"))).alias("de_tabela"), F.count_if(T.is_separator_line(F.col("x"))).alias("separadoras"))


@query(r"""WITH l AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
k AS (SELECT *, regexp_matches(x, '^\s*\|.*\|') AS tab FROM l), n AS (SELECT *, lead(tab) OVER w AS depois, lag(tab) OVER w AS antes FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, i, x, 0 AS o FROM n WHERE NOT tab),
h AS (SELECT doc_id, i, last_value(CASE WHEN NOT tab THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS v, tab, depois FROM n),
e AS (SELECT doc_id, i, '' AS x, 1 AS o FROM h WHERE tab AND coalesce(NOT depois, true) AND trim(coalesce(v, '')) <> '')
SELECT d.doc_id, coalesce(md5(r.x), md5('')) AS resto FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY i, o) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY doc_id) r ON r.doc_id = d.doc_id""")
def table_block_removal(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.without_tables(F.col("text"))).alias("resto"))


@query("SELECT DISTINCT relatorio, replace(relatorio, 'sireva_', '') AS ano, starts_with(relatorio, 'sireva') AS anual FROM sireva_2014")
def report_years(spark, d):
    return table(spark, d, "sireva_2014").select("relatorio", T.year_of(F.col("relatorio")).alias("ano"), F.col("relatorio").startswith("sireva").alias("anual")).distinct()


# ---- tokens, spans, tags

@query(rf"""WITH {U}, l AS (SELECT sentenca_id, regexp_extract_all(texto, '[{T.BLANK}]*[^{T.BLANK}]+') AS ps FROM u), x AS (SELECT sentenca_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS pos FROM l),
o AS (SELECT *, sum(length(p)) OVER (PARTITION BY sentenca_id ORDER BY pos) AS e, regexp_replace(p, '^[{T.BLANK}]+', '') AS token FROM x)
SELECT sentenca_id, CAST(pos AS INTEGER) AS pos, token, CAST(e - length(token) AS INTEGER) AS inicio, CAST(e AS INTEGER) AS fim FROM o""")
def token_offsets(spark, d):
    u = text_units(spark, d).select("sentenca_id", F.posexplode(G.token_offsets(F.col("texto"))).alias("pos", "o"))
    return u.select("sentenca_id", "pos", "o.token", F.col("o.s").alias("inicio"), F.col("o.e").alias("fim"))


@query(SQL["token_offsets"])
def recovered_offsets(spark, d):
    """The offsets again, found from the tokens alone."""
    u = text_units(spark, d).select("sentenca_id", F.posexplode(G.recovered_offsets(G.tokens(F.col("texto")), F.col("texto"))).alias("pos", "o"))
    return u.select("sentenca_id", "pos", "o.token", F.col("o.s").alias("inicio"), F.col("o.e").alias("fim"))


@query(f"WITH {TOK}, x AS (SELECT relatorio, len(ts) AS a, len(string_split(texto, ' ')) AS b FROM tl) SELECT relatorio, count(*) AS unidades, count(*) FILTER (a > 0 AND a = b) AS coerentes FROM x GROUP BY 1")
def consistent_lengths(spark, d):
    """Units by white space against tags by single spaces."""
    u = text_units(spark, d).withColumn("ok", G.consistent(G.tokens(F.col("texto")), annotate.rule_tags(F.split("texto", " "))))
    return u.groupBy("relatorio").agg(F.count("*").alias("unidades"), F.count_if("ok").alias("coerentes"))


def _cells(spark, d):
    """Table rows with the suggestions written in the reference's own notation."""
    r = review(spark, d).where("texto is not null and entidades_sugeridas is not null").groupBy("id", "texto").agg(F.min("entidades_sugeridas").alias("c"))
    return r.withColumn("spans", G.from_readable(F.col("c")))


CELLS = r"""c AS (SELECT id, texto, min(entidades_sugeridas) AS c FROM annotation_tabelas WHERE texto IS NOT NULL AND entidades_sugeridas IS NOT NULL GROUP BY 1, 2),
parts AS (SELECT id, texto, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (SELECT id, texto, string_split(c, ';') AS l FROM c)),
sp AS (SELECT id, texto, n, trim(regexp_extract(p, '(?s)^(.*?)→', 1), E' \t\n\r') AS m, upper(trim(regexp_extract(p, '(?s)^.*?→(.*)$', 1), E' \t\n\r')) AS tipo FROM parts WHERE p LIKE '%→%'),
spans AS (SELECT id, texto, row_number() OVER (PARTITION BY id, texto ORDER BY n) - 1 AS ord, m, tipo FROM sp WHERE m <> '' AND tipo IN (""" + ", ".join(f"'{t}'" for t in ENTITY_TYPES) + "))"
CTOK = rf"""{CELLS}, pl AS (SELECT id, texto, regexp_extract_all(texto, '[{T.BLANK}]*[^{T.BLANK}]+') AS ps FROM c), px AS (SELECT id, texto, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS pos FROM pl),
tk AS (SELECT id, texto, pos, sum(length(p)) OVER (PARTITION BY id, texto ORDER BY pos) AS e, regexp_replace(p, '^[{T.BLANK}]+', '') AS token FROM px),
places AS (SELECT id, texto, ord, tipo, length(m) AS n, CASE WHEN strpos(texto, m) > 0 THEN strpos(texto, m) ELSE strpos(lower(texto), lower(m)) END - 1 AS s FROM spans)"""


@query(f"WITH {CTOK} SELECT id, texto, CAST(ord AS INTEGER) AS ord, tipo, CAST(s AS INTEGER) AS s, CAST(s + n AS INTEGER) AS e FROM places WHERE s >= 0")
def first_occurrence_spans(spark, d):
    return _cells(spark, d).select("id", "texto", F.explode(G.first_places(F.col("spans"), F.col("texto"))).alias("p")).select("id", "texto", "p.ord", "p.tipo", "p.s", "p.e")


@query(f"""WITH {CTOK}, hit AS (SELECT t.id, t.texto, t.pos, p.ord, p.tipo, min(t.pos) OVER (PARTITION BY t.id, t.texto, p.ord) AS f FROM tk t JOIN places p ON p.id = t.id AND p.texto = t.texto AND p.s >= 0 AND t.e - length(t.token) < p.s + p.n AND t.e > p.s),
best AS (SELECT id, texto, pos, max_by(CASE WHEN pos = f THEN 'B-' ELSE 'I-' END || tipo, ord) AS tag FROM hit GROUP BY 1, 2, 3)
SELECT t.id, t.texto, CAST(t.pos AS INTEGER) AS pos, coalesce(b.tag, 'O') AS tag FROM tk t LEFT JOIN best b ON b.id = t.id AND b.texto = t.texto AND b.pos = t.pos""")
def silver_bio(spark, d):
    c = _cells(spark, d).withColumn("o", G.token_offsets(F.col("texto"))).withColumn("p", G.first_places(F.col("spans"), F.col("texto")))
    return c.select("id", "texto", F.posexplode(G.silver_tags(F.col("o"), F.col("p"))).alias("pos", "tag"))


@query()
def gold_bio(spark, d):
    c = _cells(spark, d).withColumn("l", locate.loose_places(F.col("spans"), F.col("texto"))).withColumn("o", G.token_offsets(F.col("texto"))).withColumn("p", G.chosen_places(F.col("spans"), F.col("texto"), F.col("l")))
    return c.select("id", "texto", F.posexplode(G.gold_tags(F.col("o"), F.col("p"))).alias("pos", "tag"))


@query(f"WITH {SPANS} SELECT sentenca_id, tipo, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM sa")
def bio_to_spans(spark, d):
    return metrics.entity_rows(gold_units(spark, d), "bio_tags", "sentenca_id")


@query(f"WITH {SPANS} SELECT sentenca_id, texto, tipo, count(*) AS n FROM sa GROUP BY 1, 2, 3")
def span_texts(spark, d):
    return gold_units(spark, d).select("sentenca_id", F.explode("spans").alias("x")).groupBy("sentenca_id", "x.texto", "x.tipo").agg(F.count("*").alias("n"))


CHARS = rf"""{SPANS}, l2 AS (SELECT sentenca_id, texto, regexp_extract_all(texto, '[{T.BLANK}]*[^{T.BLANK}]+') AS ps FROM u), x2 AS (SELECT sentenca_id, texto, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS pos FROM l2),
o2 AS (SELECT sentenca_id, texto, pos, sum(length(p)) OVER (PARTITION BY sentenca_id ORDER BY pos) AS e, length(regexp_replace(p, '^[{T.BLANK}]+', '')) AS n FROM x2)"""


@query(f"""WITH {CHARS} SELECT a.sentenca_id, 't' || (row_number() OVER (PARTITION BY a.sentenca_id ORDER BY a.i) - 1) AS id, CAST(f.e - f.n AS INTEGER) AS s, CAST(z.e AS INTEGER) AS e, a.tipo, substring(f.texto, CAST(f.e - f.n + 1 AS BIGINT), CAST(z.e - f.e + f.n AS BIGINT)) AS texto
FROM sa a JOIN o2 f ON f.sentenca_id = a.sentenca_id AND f.pos = a.i JOIN o2 z ON z.sentenca_id = a.sentenca_id AND z.pos = a.j - 1""")
def char_spans(spark, d):
    u = gold_units(spark, d).withColumn("o", G.token_offsets(F.col("texto"))).select("sentenca_id", F.explode(G.char_spans(F.col("bio_tags"), F.col("o"), F.col("texto"))).alias("x"))
    return u.select("sentenca_id", "x.id", "x.s", "x.e", "x.tipo", "x.texto")


@query(f"""WITH {TAGS}, q AS (SELECT *, CASE WHEN ta = 'O' THEN 'O' WHEN pos % 2 = 1 THEN 'I-' || ka ELSE ta END AS tg FROM g),
b AS (SELECT *, lag(tg) OVER (PARTITION BY sentenca_id ORDER BY pos) AS ant FROM q), k2 AS (SELECT *, sum(CASE WHEN tg LIKE 'B-%' OR tg = 'O' OR (tg LIKE 'I-%' AND coalesce(ant, 'O') = 'O') THEN 1 ELSE 0 END) OVER (PARTITION BY sentenca_id ORDER BY pos) AS gid FROM b)
SELECT sentenca_id, substring(min_by(tg, pos), 3) AS tipo, CAST(min(pos) AS INTEGER) AS i, CAST(max(pos) + 1 AS INTEGER) AS j FROM k2 GROUP BY sentenca_id, gid HAVING min_by(tg, pos) LIKE 'B-%'""")
def lenient_spans(spark, d):
    """Entities of sequences in which every other tag was turned into an I-."""
    u = gold_units(spark, d).withColumn("tg", F.transform("bio_tags", lambda t, i: F.when((t != "O") & (i % 2 == 1), F.concat(F.lit("I-"), F.substring(t, 3, 100))).otherwise(t)))
    return metrics.entity_rows(u, "tg", "sentenca_id", lenient=True)


@query(rf"""WITH {CELLS} SELECT id, texto, n AS numero, count(*) AS q FROM (SELECT id, texto, unnest(regexp_extract_all(m, '\d+(?:[.,]\d+)*')) AS n FROM spans WHERE tipo = 'METRICA_EPI') GROUP BY 1, 2, 3""")
def number_explode(spark, d):
    s = _cells(spark, d).select("id", "texto", F.explode(G.numbers_apart(F.filter("spans", lambda x: x["tipo"] == "METRICA_EPI"))).alias("x"))
    return s.groupBy("id", "texto", F.col("x.texto").alias("numero")).agg(F.count("*").alias("q"))


@query(f"""WITH {CELLS} SELECT c.id, c.texto, coalesce(s.legivel, '(nenhuma)') AS legivel FROM c LEFT JOIN (SELECT id, texto, string_agg(m || ' → ' || tipo, '; ' ORDER BY ord) AS legivel FROM spans GROUP BY 1, 2) s ON s.id = c.id AND s.texto = c.texto""")
def readable_roundtrip(spark, d):
    return _cells(spark, d).select("id", "texto", G.readable(F.col("spans")).alias("legivel"))


@query("""SELECT linha, CASE WHEN trim(coalesce(entidades_corrigidas, ''), E' \\t\\n\\r') <> '' AND NOT regexp_matches(entidades_corrigidas, '(?i)^\\s*\\(?\\s*nenhuma\\s*\\)?\\s*$') THEN trim(entidades_corrigidas, E' \\t\\n\\r') ELSE coalesce(entidades_sugeridas, '') END AS celula FROM annotation_tabelas""")
def final_cells(spark, d):
    return review(spark, d).select("linha", G.final_cell(F.col("entidades_sugeridas"), F.col("entidades_corrigidas")).alias("celula"))


@query("""SELECT event_id, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS INTEGER) AS k FROM events""")
def json_cells(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(0)).alias("k"))


@query(f"WITH {TAGS} SELECT sentenca_id, bool_or(ta <> 'O') AS com, count(*) AS tokens FROM g GROUP BY 1")
def entity_flags(spark, d):
    u = gold_units(spark, d).where(F.size("tokens") > 0)
    return u.select("sentenca_id", G.has_entity(F.col("bio_tags")).alias("com"), F.size("tokens").cast("long").alias("tokens"))


# ---- joins and sets

def _gold_ids(spark, d):
    return table(spark, d, "particoes").where("particao = 'teste'").select("sentenca_id").distinct()


@query(f"WITH {TOK}, x AS (SELECT sentenca_id, len(ts) AS a, len(string_split(texto, ' ')) AS b FROM tl) SELECT sentenca_id, CAST(least(a, b) AS INTEGER) AS n, a <> b AS descasada FROM x")
def align_inner(spark, d):
    """Units of one side by white space, of the other by single spaces, cut to the shorter."""
    u = text_units(spark, d)
    one = u.withColumn("tokens", G.tokens(F.col("texto"))).withColumn("bio_tags", annotate.rule_tags(F.col("tokens"))).select("sentenca_id", "tokens", "bio_tags")
    two = u.select("sentenca_id", annotate.rule_tags(F.split("texto", " ")).alias("bio_tags"))
    return metrics.aligned(one, two).select("sentenca_id", F.size("ga").alias("n"), "descasada")


@query(f"WITH {U} SELECT count(*) AS faltam FROM (SELECT DISTINCT sentenca_id FROM particoes WHERE particao = 'teste') g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.sentenca_id = g.sentenca_id)")
def missing_anti(spark, d):
    return _gold_ids(spark, d).join(text_units(spark, d).select("sentenca_id"), "sentenca_id", "left_anti").agg(F.count("*").alias("faltam"))


@query(f"WITH {U} SELECT sentenca_id, relatorio FROM u WHERE sentenca_id IN (SELECT sentenca_id FROM particoes WHERE particao = 'teste')")
def gold_semi(spark, d):
    return text_units(spark, d).join(_gold_ids(spark, d), "sentenca_id", "left_semi").select("sentenca_id", "relatorio")


@query(f"WITH {U} SELECT sentenca_id, relatorio FROM u WHERE sentenca_id NOT IN (SELECT sentenca_id FROM particoes WHERE particao = 'teste' AND sentenca_id IS NOT NULL)")
def train_anti(spark, d):
    return text_units(spark, d).join(_gold_ids(spark, d), "sentenca_id", "left_anti").select("sentenca_id", "relatorio")


@query(f"""WITH {TOK}, x AS (SELECT sentenca_id, ts, string_split(texto, ' ') AS b FROM tl), g AS (SELECT DISTINCT sentenca_id FROM particoes WHERE particao = 'teste' AND sentenca_id IS NOT NULL)
SELECT x.sentenca_id, CASE WHEN NOT x.sentenca_id IN (SELECT sentenca_id FROM g) THEN 'ausente' ELSE 'tokens' END AS problema FROM x WHERE NOT x.sentenca_id IN (SELECT sentenca_id FROM g) OR ts <> b""")
def pairing_problems(spark, d):
    """Units by white space against the test split's units by single spaces."""
    u = text_units(spark, d)
    other = u.join(_gold_ids(spark, d), "sentenca_id", "left_semi").select("sentenca_id", F.split("texto", " ").alias("tokens"))
    return metrics.pairing_problems(u.select("sentenca_id", G.tokens(F.col("texto")).alias("tokens")), other)


@query("SELECT id FROM (SELECT DISTINCT id FROM annotation_tabelas WHERE anotador = 'anot_10' INTERSECT SELECT DISTINCT id FROM annotation_tabelas WHERE anotador = 'anot_04')")
def common_ids(spark, d):
    r = review(spark, d)
    return r.where("anotador = 'anot_10'").select("id").intersect(r.where("anotador = 'anot_04'").select("id"))


@query("""WITH a AS (SELECT DISTINCT sentenca_id, 'texto' AS origem FROM particoes WHERE particao = 'treino'), b AS (SELECT DISTINCT sentenca_id, 'revisto' AS origem FROM particoes WHERE particao = 'teste')
SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sentenca_id = a.sentenca_id)""")
def right_wins_union(spark, d):
    p = table(spark, d, "particoes")
    side = lambda k, o: p.where(F.col("particao") == k).select("sentenca_id").distinct().withColumn("origem", F.lit(o))
    return units.right_wins(side("treino", "texto"), side("teste", "revisto"), "sentenca_id")


@query("WITH m AS (SELECT source, peso_alvo FROM mistura_alvo WHERE source LIKE 'sireva%') SELECT d.doc_id, coalesce(m.peso_alvo, 0.0) AS peso_alvo FROM documents d LEFT JOIN m ON m.source = d.source")
def lookup_default(spark, d):
    m = table(spark, d, "mistura_alvo").where(F.col("source").startswith("sireva"))
    return units.with_default(table(spark, d, "documents").select("doc_id", "source"), m, "source", "peso_alvo", 0.0).select("doc_id", "peso_alvo")


@query(f"WITH {SPANS}, {TYPES_SQL} SELECT ts.tipo, coalesce(n, 0) AS n FROM ts LEFT JOIN (SELECT tipo, count(*) AS n FROM sb GROUP BY 1) x ON x.tipo = ts.tipo")
def dimension_fill(spark, d):
    u = annotate.annotated(text_units(spark, d), rules=annotate.RULES_B)
    return stats.filled(stats.type_counts(u), tagset(spark)).select("tipo", "n")


# ---- statistics

SIZES = f"{TAGS}, z AS (SELECT relatorio, sentenca_id, count(*) AS n, count(*) FILTER (ta LIKE 'B-%') AS e, bool_or(ta <> 'O') AS com FROM g GROUP BY 1, 2)"


@query(f"WITH {SIZES} SELECT (SELECT count(*) FROM u) AS unidades, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(e) AS BIGINT) AS entidades, count(*) FILTER (com) AS com_entidade, {r4('100.0 * count(*) FILTER (com) / (SELECT count(*) FROM u)', 1)} AS parte FROM z")
def corpus_totals(spark, d):
    return stats.corpus_totals(gold_units(spark, d))


@query(f"WITH {TOK}, z AS (SELECT len(ts) AS n FROM tl) SELECT {r4('avg(n)')} AS media, quantile_cont(n, 0.5) AS mediana, {r4('stddev_pop(n)')} AS desvio, CAST(min(n) AS INTEGER) AS minimo, CAST(max(n) AS INTEGER) AS maximo FROM z")
def length_stats(spark, d):
    return stats.length_stats(gold_units(spark, d))


@query(f"""WITH {SIZES}, y AS (SELECT u.relatorio, coalesce(n, 0) AS n, coalesce(e, 0) AS e, coalesce(com, false) AS com FROM u LEFT JOIN z ON z.sentenca_id = u.sentenca_id)
SELECT CASE WHEN grouping(relatorio) = 1 THEN 'TOTAL' ELSE relatorio END AS relatorio, count(*) AS unidades, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(e) AS BIGINT) AS entidades, count(*) FILTER (com) AS com_entidade,
{r4('CAST(100 * count(*) FILTER (com) AS DOUBLE) / count(*)', 1)} AS parte, {r4('CAST(sum(e) AS DOUBLE) / count(*)', 2)} AS por_unidade FROM y GROUP BY ROLLUP (relatorio)""")
def per_source_stats(spark, d):
    return stats.per_report(gold_units(spark, d))


@query(f"WITH {SPANS}, {TYPES_SQL}, x AS (SELECT ts.tipo, count(sa.tipo) AS n FROM ts LEFT JOIN sa ON sa.tipo = ts.tipo GROUP BY 1) SELECT tipo, n, {r4('CAST(100 * n AS DOUBLE) / greatest(sum(n) OVER (), 1)', 1)} AS parte FROM x")
def type_share(spark, d):
    return stats.type_share(gold_units(spark, d), tagset(spark))


@query(f"WITH {SPANS} SELECT relatorio, " + ", ".join(f"count(*) FILTER (tipo = '{t}') AS {t}" for t in ENTITY_TYPES) + " FROM sa GROUP BY 1")
def type_pivot(spark, d):
    return stats.type_pivot(gold_units(spark, d), "relatorio")


@query(f"WITH {SPANS}, m AS (SELECT tipo, lower(trim(texto)) AS mencao, count(*) AS n FROM sa GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tipo ORDER BY n DESC, mencao) AS posto FROM m) SELECT tipo, mencao, n, CAST(posto AS INTEGER) AS posto FROM r WHERE posto <= 10")
def topk_mentions(spark, d):
    return stats.top_mentions(gold_units(spark, d))


@query(f"WITH {SIZES}, y AS (SELECT coalesce(n, 0) AS n, coalesce(com, false) AS com FROM u LEFT JOIN z ON z.sentenca_id = u.sentenca_id) SELECT CAST(n // 5 * 5 AS BIGINT) AS de, com, count(*) AS unidades FROM y GROUP BY 1, 2")
def length_hist(spark, d):
    return stats.length_histogram(gold_units(spark, d))


@query(f"WITH {TOK} SELECT count(*) FILTER (len(ts) < 8) AS curtas, {r4('100.0 * count(*) FILTER (len(ts) < 8) / count(*)', 1)} AS parte FROM tl")
def short_share(spark, d):
    return stats.short_share(gold_units(spark, d))


@query(f"WITH {SPANS}, k3 AS (SELECT DISTINCT sentenca_id, tipo FROM sa) SELECT x.tipo AS a, y.tipo AS b, count(*) AS n FROM k3 x JOIN k3 y ON x.sentenca_id = y.sentenca_id GROUP BY 1, 2")
def cooccurrence(spark, d):
    return stats.cooccurrence(gold_units(spark, d))


@query(f"""WITH {SPANS}, {TYPES_SQL}, x AS (SELECT tipo, count(*) FILTER (relatorio LIKE 'sireva%') AS a, count(*) FILTER (relatorio NOT LIKE 'sireva%') AS b FROM sa GROUP BY 1)
SELECT ts.tipo, {r4('CAST(100 * coalesce(a, 0) AS DOUBLE) / greatest(sum(a) OVER (), 1)', 1)} AS parte_1, {r4('CAST(100 * coalesce(b, 0) AS DOUBLE) / greatest(sum(b) OVER (), 1)', 1)} AS parte_2 FROM ts LEFT JOIN x ON x.tipo = ts.tipo""")
def subcorpus_compare(spark, d):
    return stats.compared(gold_units(spark, d), tagset(spark), F.col("relatorio").startswith("sireva"))


@query(f"WITH {SPANS} SELECT DISTINCT lower(trim(texto)) AS mencao FROM sa WHERE tipo = 'SOROTIPO'")
def distinct_variants(spark, d):
    return stats.mentions(gold_units(spark, d)).where("tipo = 'SOROTIPO'").select("mencao").distinct()


@query(f"WITH {SPANS}, {TYPES_SQL} SELECT tipo FROM ts WHERE tipo NOT IN (SELECT tipo FROM sa)")
def missing_types(spark, d):
    return stats.missing_types(gold_units(spark, d), tagset(spark))


# ---- scores and agreement

@query(f"WITH {OUTCOMES} SELECT tipo AS entity, {r4('p')} AS precision, {r4('r')} AS recall, {r4('f1')} AS f1, CAST(suporte AS BIGINT) AS support FROM f")
def prf_by_type(spark, d):
    return metrics.prf_by_type(pairs(spark, d))


@query(f"""WITH {OUTCOMES}, s AS (SELECT sum(tp) AS tp, sum(pred) AS pred, sum(suporte) AS su, avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf, sum(p * suporte) / sum(suporte) AS wp, sum(r * suporte) / sum(suporte) AS wr, sum(f1 * suporte) / sum(suporte) AS wf FROM f)
SELECT 'micro avg' AS entity, {r4('tp / pred')} AS precision, {r4('tp / su')} AS recall, {r4('2 * tp / (pred + su)')} AS f1, CAST(su AS BIGINT) AS support FROM s
UNION ALL SELECT 'macro avg', {r4('mp')}, {r4('mr')}, {r4('mf')}, CAST(su AS BIGINT) FROM s UNION ALL SELECT 'weighted avg', {r4('wp')}, {r4('wr')}, {r4('wf')}, CAST(su AS BIGINT) FROM s""")
def prf_averages(spark, d):
    return metrics.prf_averages(pairs(spark, d))


@query(f"WITH {OUTCOMES}, x AS (SELECT relatorio, CAST(sum(tp) AS DOUBLE) AS tp, sum(pred) AS pred, sum(suporte) AS su FROM oc GROUP BY 1) SELECT relatorio, {r4('2 * tp / (pred + su)', 3)} AS f1, CAST(su AS BIGINT) AS support FROM x")
def f1_by_source(spark, d):
    return metrics.f1_by(pairs(spark, d), "relatorio")


@query(f"WITH {SPANS} SELECT a.tipo AS gold, coalesce(b.tipo, 'MISS') AS pred, count(*) AS n FROM sa a LEFT JOIN sb b ON a.sentenca_id = b.sentenca_id AND a.i = b.i AND a.j = b.j GROUP BY 1, 2")
def confusion(spark, d):
    return metrics.confusion(pairs(spark, d))


@query(f"""WITH {SPANS}, e AS (SELECT 'FN' AS erro, a.tipo, a.sentenca_id, a.i FROM sa a LEFT JOIN sb b ON a.sentenca_id = b.sentenca_id AND a.i = b.i AND a.j = b.j WHERE b.tipo IS DISTINCT FROM a.tipo
UNION ALL SELECT 'FP', b.tipo, b.sentenca_id, b.i FROM sb b WHERE NOT EXISTS (SELECT 1 FROM sa a WHERE a.sentenca_id = b.sentenca_id AND a.i = b.i AND a.j = b.j)),
r AS (SELECT *, count(*) OVER (PARTITION BY erro, tipo) AS n, row_number() OVER (PARTITION BY erro, tipo ORDER BY sentenca_id, i) AS posto FROM e)
SELECT erro, tipo, n, CAST(posto AS INTEGER) AS posto, r.sentenca_id, substring(u.texto, 1, 80) AS trecho FROM r JOIN u ON u.sentenca_id = r.sentenca_id WHERE posto <= 5""")
def fn_fp_examples(spark, d):
    p = pairs(spark, d)
    return metrics.error_examples(p, text_units(spark, d))


KAPPA = "CASE WHEN {n} = 0 OR {e} >= 1 THEN 1.0 ELSE (CAST({c} AS DOUBLE) / {n} - {e}) / (1 - {e}) END"


@query(f"""WITH {TAGS}, c AS (SELECT ta, tb, count(*) AS n FROM g GROUP BY 1, 2), a AS (SELECT ta AS r, sum(n) AS na FROM c GROUP BY 1), b AS (SELECT tb AS r, sum(n) AS nb FROM c GROUP BY 1),
s AS (SELECT sum(n) AS n, coalesce(sum(n) FILTER (ta = tb), 0) AS c FROM c), e AS (SELECT CAST(sum(na * nb) AS DOUBLE) / (SELECT CAST(n AS DOUBLE) * n FROM s) AS e FROM a JOIN b USING (r))
SELECT CAST(n AS BIGINT) AS itens, {r4('CAST(100 * c AS DOUBLE) / n', 2)} AS concordancia, {r4(KAPPA.format(n='n', e='e', c='c'))} AS kappa FROM s, e""")
def kappa(spark, d):
    return metrics.kappa_of(metrics.label_pairs(pairs(spark, d)))


@query(f"""WITH {TAGS}, c AS (SELECT coalesce(ka, kb) AS tipo, ta, tb, count(*) AS n FROM g WHERE ka IS NOT NULL OR kb IS NOT NULL GROUP BY 1, 2, 3), a AS (SELECT tipo, ta AS r, sum(n) AS na FROM c GROUP BY 1, 2), b AS (SELECT tipo, tb AS r, sum(n) AS nb FROM c GROUP BY 1, 2),
s AS (SELECT tipo, sum(n) AS n, coalesce(sum(n) FILTER (ta = tb), 0) AS c FROM c GROUP BY 1), m AS (SELECT a.tipo, CAST(sum(na * nb) AS DOUBLE) AS m FROM a JOIN b ON a.tipo = b.tipo AND a.r = b.r GROUP BY 1),
e AS (SELECT s.tipo, n, c, coalesce(m, 0) / (CAST(n AS DOUBLE) * n) AS e FROM s LEFT JOIN m ON m.tipo = s.tipo)
SELECT tipo, CAST(n AS BIGINT) AS itens, {r4('CAST(100 * c AS DOUBLE) / n', 2)} AS concordancia, {r4(KAPPA.format(n='n', e='e', c='c'))} AS kappa FROM e""")
def kappa_by_type(spark, d):
    return metrics.kappa_by_type(pairs(spark, d))


@query(f"WITH {TAGS} SELECT sentenca_id, {r4('100.0 * avg(CASE WHEN ta = tb THEN 1 ELSE 0 END)', 2)} AS concordancia FROM g GROUP BY 1")
def token_agreement(spark, d):
    return metrics.token_agreement(pairs(spark, d))


MENTIONS = f"{SPANS}, ma AS (SELECT sentenca_id, lower(texto) AS m, tipo, count(*) AS n FROM sa GROUP BY 1, 2, 3), mb AS (SELECT sentenca_id, lower(texto) AS m, tipo, count(*) AS n FROM sb GROUP BY 1, 2, 3)"


@query(f"""WITH {MENTIONS}, ca AS (SELECT sentenca_id, sum(n) AS n FROM ma GROUP BY 1), cb AS (SELECT sentenca_id, sum(n) AS n FROM mb GROUP BY 1), ci AS (SELECT sentenca_id, count(*) AS n FROM ma JOIN mb USING (sentenca_id, m, tipo) GROUP BY 1)
SELECT u.sentenca_id, {r4('CASE WHEN coalesce(ca.n, 0) + coalesce(cb.n, 0) = 0 THEN 1.0 ELSE CAST(2 * coalesce(ci.n, 0) AS DOUBLE) / (coalesce(ca.n, 0) + coalesce(cb.n, 0)) END')} AS f1
FROM u LEFT JOIN ca ON ca.sentenca_id = u.sentenca_id LEFT JOIN cb ON cb.sentenca_id = u.sentenca_id LEFT JOIN ci ON ci.sentenca_id = u.sentenca_id""")
def span_f1_units(spark, d):
    return metrics.span_f1_units(pairs(spark, d))


@query(f"""WITH {MENTIONS}, ca AS (SELECT sentenca_id, sum(n) AS n FROM ma GROUP BY 1), cb AS (SELECT sentenca_id, sum(n) AS n FROM mb GROUP BY 1), ci AS (SELECT sentenca_id, count(*) AS n FROM ma JOIN mb USING (sentenca_id, m, tipo) GROUP BY 1)
SELECT count(*) AS unidades, {r4('avg(CASE WHEN coalesce(ca.n, 0) + coalesce(cb.n, 0) = 0 THEN 1.0 ELSE CAST(2 * coalesce(ci.n, 0) AS DOUBLE) / (coalesce(ca.n, 0) + coalesce(cb.n, 0)) END)')} AS f1
FROM u LEFT JOIN ca ON ca.sentenca_id = u.sentenca_id LEFT JOIN cb ON cb.sentenca_id = u.sentenca_id LEFT JOIN ci ON ci.sentenca_id = u.sentenca_id""")
def span_f1_mean(spark, d):
    return metrics.span_f1_mean(pairs(spark, d))


@query(f"""WITH {MENTIONS}, x AS (SELECT coalesce(ma.tipo, mb.tipo) AS tipo, count(*) FILTER (ma.m IS NOT NULL AND mb.m IS NOT NULL) AS i, count(ma.m) AS a, count(mb.m) AS b FROM ma FULL JOIN mb ON ma.sentenca_id = mb.sentenca_id AND ma.m = mb.m AND ma.tipo = mb.tipo GROUP BY 1)
SELECT tipo, i AS intersect, a AS total_a, b AS total_b, {r4('CASE WHEN a + b = 0 THEN 0 ELSE CAST(2 * i AS DOUBLE) / (a + b) END')} AS f1 FROM x""".replace("AS intersect", 'AS "intersect"'))
def span_counts(spark, d):
    return metrics.span_counts(pairs(spark, d))


# ---- gold building

STATUS_SQL = "lower(trim(coalesce(status, '')))"


@query(f"""SELECT count(*) AS total, count(*) FILTER ({STATUS_SQL} NOT IN ('corrigido', 'erro', 'skip', 'ignorar', 'pendente')) AS ok, count(*) FILTER ({STATUS_SQL} = 'corrigido') AS corrigido, count(*) FILTER ({STATUS_SQL} = 'erro') AS erro,
count(*) FILTER ({STATUS_SQL} IN ('skip', 'ignorar')) AS pulado, count(*) FILTER ({STATUS_SQL} = 'pendente') AS pendente, count(*) FILTER (trim(coalesce(texto, '')) = '') AS sem_texto FROM annotation_tabelas""")
def build_counters(spark, d):
    return gold.counters(review(spark, d), "status", "texto")


@query()
def build_gold(spark, d):
    rows = review(spark, d).select("linha", "id", "texto", "status", G.from_readable(F.col("entidades_sugeridas")).alias("spans_silver"), G.from_readable(F.col("entidades_corrigidas")).alias("spans_correto"))
    done = gold.build_gold(rows)
    return done.select("linha", "id", F.array_join("bio_tags", " ").alias("tags"), G.readable(F.col("spans")).alias("spans"))


# ---- sampling

def _strata(spark, d):
    return text_units(spark, d).groupBy("relatorio").agg(F.count("*").alias("n"))


def _alloc(n: int, least: int, src: str) -> str:
    return f"""q AS (SELECT relatorio, n, CAST(n AS DOUBLE) / sum(n) OVER () * greatest(0, {n} - {least} * count(*) OVER ()) AS x, greatest(0, {n} - {least} * count(*) OVER ()) AS resto FROM {src}),
w AS (SELECT *, floor(x) AS f, x - floor(x) AS rem, resto - sum(floor(x)) OVER () AS sobra FROM q), v AS (SELECT *, row_number() OVER (ORDER BY rem DESC, relatorio) AS posto FROM w)"""


@query(f"WITH {U}, st AS (SELECT relatorio, count(*) AS n FROM u GROUP BY 1), {_alloc(400, 5, 'st')} SELECT relatorio, n, CAST(least(n, f + 5 + CASE WHEN posto <= sobra THEN 1 ELSE 0 END) AS BIGINT) AS alocado FROM v")
def alloc_min5(spark, d):
    return sampling.allocation(_strata(spark, d), "relatorio", "n", 400, 5)


@query(f"""WITH {SIZES}, y AS (SELECT u.relatorio, coalesce(com, false) AS com, count(*) AS n FROM u LEFT JOIN z ON z.sentenca_id = u.sentenca_id GROUP BY 1, 2),
q AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY com) * 200 AS x FROM y), w AS (SELECT *, floor(x) AS f, x - floor(x) AS rem, 200 - sum(floor(x)) OVER (PARTITION BY com) AS sobra FROM q),
v AS (SELECT *, row_number() OVER (PARTITION BY com ORDER BY rem DESC, relatorio) AS posto FROM w) SELECT relatorio, com, n, CAST(least(n, f + CASE WHEN posto <= sobra THEN 1 ELSE 0 END) AS BIGINT) AS alocado FROM v""")
def alloc_two_pools(spark, d):
    s = stats.sizes(gold_units(spark, d), "relatorio").groupBy("relatorio", "com").agg(F.count("*").alias("n"))
    return sampling.allocation(s, "relatorio", "n", 200, pool="com")


@query(f"""WITH {SIZES}, st AS (SELECT u.relatorio, count(*) AS n, count(*) FILTER (coalesce(com, false)) AS c FROM u LEFT JOIN z ON z.sentenca_id = u.sentenca_id GROUP BY 1), {_alloc(400, 5, 'st')},
h AS (SELECT v.relatorio, least(v.n, f + 5 + CASE WHEN posto <= sobra THEN 1 ELSE 0 END) AS al, st.c, v.n - st.c AS s FROM v JOIN st ON st.relatorio = v.relatorio),
i2 AS (SELECT *, least(al - least(round_even(al * 0.5, 0), c), s) AS sem FROM h) SELECT relatorio, CAST(al AS BIGINT) AS alocado, CAST(least(c, al - sem) AS BIGINT) AS com, CAST(sem AS BIGINT) AS sem FROM i2""")
def stratum_split(spark, d):
    s = stats.sizes(gold_units(spark, d), "relatorio").groupBy("relatorio").agg(F.count("*").alias("n"), F.count_if("com").alias("c"), F.count_if(~F.col("com")).alias("s"))
    return sampling.split_strata(sampling.allocation(s, "relatorio", "n", 400, 5), "c", "s").select("relatorio", "alocado", "com", "sem")


@query(f"""WITH {U}, st AS (SELECT relatorio, count(*) AS n FROM u GROUP BY 1), {_alloc(400, 5, 'st')}, k AS (SELECT u.relatorio, sentenca_id, row_number() OVER (PARTITION BY u.relatorio ORDER BY md5(sentenca_id || '|42'), sentenca_id) AS k FROM u)
SELECT k.relatorio, sentenca_id FROM k JOIN v ON v.relatorio = k.relatorio WHERE k <= least(n, f + 5 + CASE WHEN posto <= sobra THEN 1 ELSE 0 END)""")
def hash_sample(spark, d):
    quotas = sampling.allocation(_strata(spark, d), "relatorio", "n", 400, 5)
    return sampling.drawn(text_units(spark, d), quotas, ["relatorio"], "alocado", "sentenca_id", 42, 400).select("relatorio", "sentenca_id")


@query(f"WITH {SIZES} SELECT u.relatorio, count(*) AS unidades, count(*) FILTER (coalesce(com, false)) AS com_entidade FROM u LEFT JOIN z ON z.sentenca_id = u.sentenca_id GROUP BY 1")
def sample_summary(spark, d):
    return stats.sizes(gold_units(spark, d), "relatorio").groupBy("relatorio").agg(F.count("*").alias("unidades"), F.count_if("com").alias("com_entidade"))


# ---- boundaries

@query("SELECT '- ' || nome || ': ' || descricao AS linha FROM tagset")
def tagset_lines(spark, d):
    p = annotate.tagset_prompt(table(spark, d, "tagset"), "nome", "descricao")
    return p.select(F.explode(F.split("prompt", "\n")).alias("linha"))


@query("""SELECT nome, 'model' AS papel, descricao AS parte FROM tagset""")
def chat_remap(spark, d):
    t = table(spark, d, "tagset").select("nome", annotate.remapped_turns(F.array(F.struct(F.lit("assistant").alias("role"), F.col("descricao").alias("content")))).alias("t"))
    return t.select("nome", F.explode("t").alias("x")).select("nome", F.col("x.role").alias("papel"), F.element_at("x.parts", 1).alias("parte"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


