"""Column functions on tokens, spans and IOB2 tag sequences.

All of them work on one unit's arrays, so none shuffles; tables of spans come from exploding the results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folhetim.functions.text import BLANK, says_none, strip
from folhetim.schema import ENTITY_TYPES

SPANS = "array<struct<texto:string,tipo:string>>"
NUMBER = r"\d+(?:[.,]\d+)*"


def tokens(text: Column) -> Column:
    """``array<string>``: the runs of characters other than white space; empty for ''."""
    return F.regexp_extract_all(text, F.lit(rf"[^{BLANK}]+"), 0)


def token_offsets(text: Column) -> Column:
    """``array<struct<token,s,e>>``: tokens with their places in the text, end excluded."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[{BLANK}]*[^{BLANK}]+"), 0)
    empty = F.array().cast("array<struct<token:string,s:int,e:int>>")

    def step(done: Column, piece: Column) -> Column:
        token = F.regexp_replace(piece, rf"^[{BLANK}]+", "")
        end = F.coalesce(F.try_element_at(done, F.lit(-1))["e"], F.lit(0)) + F.length(piece)
        return F.concat(done, F.array(F.struct(token.alias("token"), (end - F.length(token)).alias("s"), end.alias("e"))))

    return F.aggregate(pieces, empty, step)


def recovered_offsets(toks: Column, text: Column) -> Column:
    """``array<struct<token,s,e>>`` by looking for each token from the end of the one before; null places where it isn't found."""
    start = F.struct(F.array().cast("array<struct<token:string,s:int,e:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        found = F.locate(t, text, acc["at"] + 1) if isinstance(t, str) else F.call_function("locate", t, text, acc["at"] + 1)
        s = F.when(found > 0, found - 1)
        e = s + F.length(t)
        return F.struct(F.concat(acc["out"], F.array(F.struct(t.alias("token"), s.alias("s"), e.alias("e")))).alias("out"), F.coalesce(e, acc["at"]).alias("at"))

    return F.aggregate(toks, start, step, lambda a: a["out"])


def first_places(spans: Column, text: Column) -> Column:
    """``array<struct<ord,s,e,tipo>>``: each span at its first occurrence, as written or else in lower case; others left out."""

    def place(x: Column, i: Column) -> Column:
        exact = F.call_function("locate", x["texto"], text)
        at = F.when(exact > 0, exact).otherwise(F.call_function("locate", F.lower(x["texto"]), F.lower(text)))
        return F.struct(i.alias("ord"), (at - 1).alias("s"), (at - 1 + F.length(x["texto"])).alias("e"), x["tipo"].alias("tipo"))

    return F.filter(F.transform(F.filter(spans, lambda x: (x["texto"] != "") & x["tipo"].isin(*ENTITY_TYPES)), place), lambda p: p["s"] >= 0)


def silver_tags(toks: Column, places: Column) -> Column:
    """IOB2 tags by overlap with ``first_places``; a later span overwrites earlier ones, so an I- may lose its B-."""

    def tag(t: Column, k: Column) -> Column:
        last = F.try_element_at(F.filter(places, lambda p: (t["s"] < p["e"]) & (t["e"] > p["s"])), F.lit(-1))
        before = F.when(k > 0, F.try_element_at(toks, k)["e"]).otherwise(F.lit(-1))
        return F.when(last.isNull(), F.lit("O")).otherwise(F.concat(F.when(before > last["s"], F.lit("I-")).otherwise(F.lit("B-")), last["tipo"]))

    return F.transform(toks, tag)


def valid_spans(spans: Column) -> Column:
    """Spans with a mention and a known type, the mention stripped, the type in upper case."""
    clean = F.transform(spans, lambda x: F.struct(strip(x["texto"]).alias("texto"), F.upper(x["tipo"]).alias("tipo")))
    return F.filter(clean, lambda x: (x["texto"] != "") & x["tipo"].isin(*ENTITY_TYPES))


def chosen_places(spans: Column, text: Column, loose: Column | None = None) -> Column:
    """Spans at their first occurrence in any case, longest first, none overlapping one taken before.

    ``loose``: ``array<struct<s,e>>``, a place for each of the ``valid_spans`` that the plain search misses.
    """
    lower = F.lower(text)

    def place(x: Column, i: Column) -> Column:
        at = F.call_function("locate", F.lower(x["texto"]), lower)
        s = F.when(at > 0, at - 1)
        e = s + F.length(x["texto"])
        if loose is not None:
            other = F.try_element_at(loose, i + 1)
            s, e = F.coalesce(s, other["s"]), F.coalesce(e, other["e"])
        return F.struct((-F.length(x["texto"])).alias("nl"), i.alias("ord"), s.alias("s"), e.alias("e"), x["tipo"].alias("tipo"))

    ordered = F.array_sort(F.filter(F.transform(valid_spans(spans), place), lambda p: p["s"].isNotNull()))
    empty = F.array().cast("array<struct<nl:int,ord:int,s:int,e:int,tipo:string>>")
    return F.aggregate(ordered, empty, lambda acc, x: F.when(F.exists(acc, lambda a: (a["s"] < x["e"]) & (x["s"] < a["e"])), acc).otherwise(F.concat(acc, F.array(x))))


def gold_tags(toks: Column, places: Column) -> Column:
    """IOB2 tags: a token has the type of most of its labelled characters (the first by name on a tie), B- where the type changes."""

    def kind(t: Column) -> Column:
        scores = F.transform(F.array(*[F.lit(x) for x in sorted(ENTITY_TYPES)]), lambda name: F.struct(F.aggregate(F.filter(places, lambda p: p["tipo"] == name), F.lit(0), lambda n, p: n + F.greatest(F.lit(0), F.least(t["e"], p["e"]) - F.greatest(t["s"], p["s"]))).alias("n"), name.alias("tipo")))
        most = F.array_max(F.transform(scores, lambda x: x["n"]))
        return F.when(most > 0, F.filter(scores, lambda x: x["n"] == most)[0]["tipo"])

    return tags_of_types(F.transform(toks, kind))


def tags_of_types(kinds: Column) -> Column:
    """IOB2 tags of an array of types with nulls: neighbours of one type are one entity.

    The types are zipped with themselves one place on, so that they are not worked out anew for every element.
    """
    before = F.concat(F.array(F.lit(None).cast("string")), kinds)

    def tag(x: Column, previous: Column) -> Column:
        return F.when(x.isNull(), F.lit("O")).otherwise(F.concat(F.when(previous.eqNullSafe(x), F.lit("I-")).otherwise(F.lit("B-")), x))

    return F.slice(F.zip_with(kinds, before, tag), F.lit(1), F.size(kinds))


def entity_spans(tags: Column, lenient: bool = False) -> Column:
    """``array<struct<tipo,i,j>>``: the entities of a tag sequence by token, end excluded.

    Strict: an I- continues an entity of its own type alone; any other I- ends what is open and is
    dropped. Lenient: an I- continues whatever is open.
    """
    empty = F.array().cast("array<struct<tipo:string,i:int,j:int>>")
    start = F.struct(empty.alias("done"), F.lit(False).alias("open"), F.lit(0).alias("at"))

    def step(acc: Column, tag: Column) -> Column:
        done, at = acc["done"], acc["at"]
        last = F.try_element_at(done, F.lit(-1))
        kind = F.substring(tag, 3, 100)
        begins = tag.startswith("B-")
        goes_on = tag.startswith("I-") & acc["open"] & (F.lit(True) if lenient else last["tipo"] == kind)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["tipo"].alias("tipo"), last["i"].alias("i"), (at + 1).alias("j"))))
        new = F.concat(done, F.array(F.struct(kind.alias("tipo"), at.alias("i"), (at + 1).alias("j"))))
        return F.struct(F.when(begins, new).when(goes_on, longer).otherwise(done).alias("done"), F.coalesce(begins | goes_on, F.lit(False)).alias("open"), (at + 1).alias("at"))

    return F.aggregate(tags, start, step, lambda a: a["done"])


def span_texts(tags: Column, toks: Column) -> Column:
    """``array<struct<texto,tipo>>``: the entities as text, tokens joined by a space."""
    return F.transform(entity_spans(tags), lambda x: F.struct(F.array_join(F.slice(toks, x["i"] + 1, x["j"] - x["i"]), " ").alias("texto"), x["tipo"].alias("tipo")))


def char_spans(tags: Column, offsets: Column, text: Column, lenient: bool = False) -> Column:
    """``array<struct<id,s,e,tipo,texto>>``: the entities by character; ids t0, t1, ..."""

    def span(x: Column, k: Column) -> Column:
        s, e = F.element_at(offsets, x["i"] + 1)["s"], F.element_at(offsets, x["j"])["e"]
        return F.struct(F.concat(F.lit("t"), k.cast("string")).alias("id"), s.alias("s"), e.alias("e"), x["tipo"].alias("tipo"), F.call_function("substring", text, s + 1, e - s).alias("texto"))

    return F.transform(entity_spans(tags, lenient), span)


def consistent(toks: Column, tags: Column) -> Column:
    """Whether there are tokens, and a tag for each."""
    return F.coalesce((F.size(toks) > 0) & (F.size(toks) == F.size(tags)), F.lit(False))


def has_entity(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t != "O"), F.lit(False))


def repaired(toks: Column, tags: Column, spans: Column) -> tuple[Column, Column]:
    """Tags and spans without the entity that is the word "sorotipo" itself; no blank after a comparison sign in an age span.

    An I- after a removed B- stays; the tags of age spans stay.
    """
    alone = F.exists(spans, lambda x: (x["tipo"] == "SOROTIPO") & (F.lower(F.trim(x["texto"])) == "sorotipo"))
    fixed = F.transform(F.arrays_zip(toks.alias("t"), tags.alias("g")), lambda x: F.when(alone & (x["g"] == "B-SOROTIPO") & (F.lower(x["t"]) == "sorotipo"), F.lit("O")).otherwise(x["g"]))
    kept = F.filter(spans, lambda x: ~((x["tipo"] == "SOROTIPO") & (F.lower(F.trim(x["texto"])) == "sorotipo")))
    return fixed, F.transform(kept, lambda x: F.struct(F.when(x["tipo"] == "FAIXA_ETARIA", F.regexp_replace(x["texto"], r"([<>≥≤])\s+", "$1")).otherwise(x["texto"]).alias("texto"), x["tipo"].alias("tipo")))


def numbers_apart(spans: Column) -> Column:
    """METRICA_EPI spans as the numbers in them, one span each."""
    return F.flatten(F.transform(spans, lambda x: F.when(x["tipo"] == "METRICA_EPI", F.transform(F.regexp_extract_all(x["texto"], F.lit(NUMBER), 0), lambda n: F.struct(n.alias("texto"), x["tipo"].alias("tipo")))).otherwise(F.array(x))))


def parsed_spans(cell: Column) -> Column:
    """Spans of a JSON cell; none where it can't be read."""
    return F.coalesce(F.from_json(cell, SPANS), F.array().cast(SPANS))


def parsed_entities(reply: Column) -> Column:
    """Spans of an annotator's JSON reply, ``{"entidades": [...]}``; none where it can't be read."""
    return F.coalesce(F.from_json(reply, f"entidades {SPANS}")["entidades"], F.array().cast(SPANS))


def readable(spans: Column) -> Column:
    """``a → T; b → T``, or ``(nenhuma)``."""
    return F.when(F.size(spans) > 0, F.array_join(F.transform(spans, lambda x: F.concat(x["texto"], F.lit(" → "), x["tipo"])), "; ")).otherwise(F.lit("(nenhuma)"))


def from_readable(cell: Column) -> Column:
    """Spans of a readable cell: cut at ``;``, at the first arrow; without a valid type left out."""
    parts = F.filter(F.split(F.coalesce(cell, F.lit("")), ";"), lambda p: p.contains("→"))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.regexp_extract(p, "(?s)^(.*?)→", 1)).alias("texto"), F.upper(strip(F.regexp_extract(p, "(?s)^.*?→(.*)$", 1))).alias("tipo")))
    return F.filter(pairs, lambda x: (x["texto"] != "") & x["tipo"].isin(*ENTITY_TYPES))


def final_cell(suggested: Column, corrected: Column, honour_rejects: bool = False) -> Column:
    """The cell that holds: the corrected one unless it is empty or says none; then the suggested one.

    ``honour_rejects``: "nenhuma" rejects all, and "ok" accepts the suggestions.
    """
    fixed = F.coalesce(strip(corrected), F.lit(""))
    if honour_rejects:
        return F.when(says_none(fixed), F.lit("")).when((fixed == "") | (F.lower(fixed) == "ok"), F.coalesce(suggested, F.lit(""))).otherwise(fixed)
    return F.when((fixed != "") & ~says_none(fixed), fixed).otherwise(F.coalesce(suggested, F.lit("")))


def span_key(texto: Column, tipo: Column) -> Column:
    """The key by which mentions are equal."""
    return F.struct(F.lower(strip(texto)).alias("texto"), tipo.alias("tipo"))


def all_outside(tags: Column, toks: Column) -> Column:
    """Tags, or O for all tokens where an annotator gave none."""
    return F.coalesce(tags, F.transform(toks, lambda t: F.lit("O")))


def word_pieces(labels: Column, word_ids: Column) -> Column:
    """Labels of sub-word pieces: the first piece of a word has the word's label, others and specials -100."""

    def label(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(word_ids, i))
        return F.when(w.isNull() | before.eqNullSafe(w), F.lit(-100)).otherwise(F.element_at(labels, w + 1))

    return F.transform(word_ids, label)


def word_predictions(labels: Column, predictions: Column) -> Column:
    """The predictions at pieces that carry a label."""
    return F.transform(F.filter(F.arrays_zip(labels.alias("l"), predictions.alias("p")), lambda x: x["l"] != -100), lambda x: x["p"])
