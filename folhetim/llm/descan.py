"""Repair of text from scanned pages (problem 4).

Method: running headers are the lines that repeat, fuzzily, at page edges; page numbers are lines whose
number is that of the page in the sequence of ``pagina``, or the next; both are taken out, and the lines
are joined, words broken at a line end by rules over the corpus vocabulary. A unit may run over a page
break, and the break is not marked, so a page edge may be at any line of a text: what tells a header
from a line of the text is that the text around it differs from copy to copy.

A word broken at a line end is joined, with the hyphen where the vocabulary has the hyphenated form more
often than the joined one. Misread characters are put right by the same vocabulary: a rare word that a
known confusion of characters turns into a word of the corpus many times as frequent.

The vocabulary counts all words of all different texts, summed before its shuffle: repeated deliveries
and exact copies are no further evidence for a spelling. Words and corrections meet by a
skeleton that all confusable spellings share, an equi-join. The corrections go to the workers as a
broadcast while they are few (checked), by a join otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhetim.llm.canonical import AFFECTED, canonical_text
from folhetim.llm.spread import Workspace, small, some

# What is read (right) for what is printed (left), one character or a pair.
CONFUSIONS = {
    "o": ("0",), "i": ("1", "!", "l", "|"), "l": ("1", "|", "!", "i"), "s": ("5",), "b": ("6",), "g": ("9",), "a": ("@",), "e": ("€",), "t": ("†",),
    "ç": ("¢",), "ã": ("ä",), "õ": ("ö",), "u": ("ii",), "m": ("rn",), "d": ("cl",), "h": ("li",), "z": ("2",), "q": ("9",), "w": ("vv",),
    "li": ("h",), "cl": ("d",), "rn": ("m",), "in": ("m",), "ii": ("u",), "vv": ("w",), "ni": ("m",),
}
#: Signs that inside a word can only be a misread letter.
SIGNS = {"@": "a", "€": "e", "†": "t", "¢": "ç"}
#: Signs that a line end breaks a word with.
HYPHENS = "-¬~=_–—‐‑\u00ad"

#: A word is a correction's target if it is seen so many times as often as the misread form, and so often at all.
TIMES, LEAST = 10, 5
#: Corrections are broadcast up to so many; beyond, they are joined.
BROADCAST_CORRECTIONS = 100_000
#: The headers of so many reports are broadcast.
BROADCAST_REPORTS = 10_000
#: A worker's memory of tokens is emptied beyond so many.
REMEMBERED = 200_000
#: A header repeats in at least so many different texts, and in such a share of the different texts of several lines of its report.
HEADER_UNITS, HEADER_SHARE, HEADER_LETTERS = 2, 0.05, 10
#: A text is a copy of others with a line if one in so many of its other lines is theirs too.
COPY_LINES = 3

ENDS = ".,;:()[]{}\"'“”‘’«»…?*"
AFFECTED_RE = re.compile(AFFECTED)
LETTERS_RE = re.compile(r"[^\W\d_]")
PAGE_RE = re.compile(r"[\[(•·*—–\-|\s]*(?:p[aáàâ]g(?:ina)?\s*\.?|p\s*\.|fls?\s*\.?|folha)?\s*(\d{1,4})(?:\s*(?:de|/)\s*\d{1,4})?[\])•·*—–\-|.\s]*", re.I)
#: No line of a page number has a word longer than those of PAGE_RE; others needn't be tried.
NUMBERS_RE = re.compile(r"\d+")
DIGIT_RE, LONG_WORD_RE = re.compile(r"\d"), re.compile(r"[^\W\d_]{7}")
FIGURES_RE = re.compile(r"\d(?:[\d.,/:]*\d)?")
BROKEN_RE = re.compile(rf"[^\W\d_][{HYPHENS}]$")
SIGN_RE = re.compile("[@€†¢]")
#: One misread letter inside a word that the vocabulary doesn't have, such as a name.
INSIDE_RE = re.compile(r"([^\W\d_]{2,})([01569!|])([^\W\d_]{2,})")
READ_AS = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "!": "i", "|": "l"}


def plain(text: str) -> str:
    return canonical_text(text) if AFFECTED_RE.search(text) else text


def plain_texts(texts: pa.Array) -> pa.Array:
    """``plain`` of each text of an array without nulls."""
    affected = pc.match_substring_regex(texts, AFFECTED)
    if not pc.any(affected).as_py():
        return texts
    return pc.replace_with_mask(texts, affected, pa.array([canonical_text(t) for t in texts.filter(affected).to_pylist()], pa.string()))


def core(token: str) -> str:
    """A token in lower case, without the punctuation at its ends; signs that may be letters stay."""
    return token.strip(ENDS).lower()


class Letters(dict):
    """Characters by number to their letters in lower case without accents and single confusions; '' for what is no letter."""

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(c for c in unicodedata.normalize("NFD", chr(code).lower()) if c.isalpha()).translate(SINGLE)
        return out


LETTERS = Letters()


def fold(line: str) -> str:
    """The letters of a line without accents and confusions: spellings of one header fold alike."""
    return widened(line.translate(LETTERS))


def same_header(f: str, header: dict[str, str]) -> str | None:
    """The header that a folded line is, allowing for a letter in eight that was misread or lost."""
    if f in header:
        return f
    for h in header:
        if abs(len(h) - len(f)) <= len(h) // 8 and (h[:5] == f[:5] or h[-5:] == f[-5:]) and SequenceMatcher(None, h, f, autojunk=False).ratio() >= 0.9:
            return h
    return None


# ---- vocabulary and corrections


# Characters that count as one, and those that count as two.
ALIKE = ("01!|i5b69q@€†¢äö2r", "olllls66ggaetçãõzl")
WIDE = (("u", "ll"), ("h", "ll"), ("d", "cl"), ("m", "ln"), ("w", "vv"), ("nl", "ln"))


def skeleton(word: str) -> str:
    """A key that is equal for all spellings that CONFUSIONS turn into each other."""
    return widened(word.translate(SINGLE))


def widened(out: str) -> str:
    for a, b in WIDE:
        out = out.replace(a, b)
    return out


def skeleton_column(word: Column) -> Column:
    """``skeleton`` in the JVM."""
    out = F.translate(word, *ALIKE)
    for a, b in WIDE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


SINGLE = str.maketrans(*ALIKE)


def misread_of(seen: str, meant: str) -> bool:
    """Whether ``seen`` comes from ``meant`` by confusions alone."""

    @lru_cache(None)
    def go(i: int, j: int) -> bool:
        if j == len(meant):
            return i == len(seen)
        if i < len(seen) and seen[i] == meant[j] and go(i + 1, j + 1):
            return True
        for n in (1, 2):
            for x in CONFUSIONS.get(meant[j : j + n], ()) if j + n <= len(meant) else ():
                if seen.startswith(x, i) and go(i + len(x), j + n):
                    return True
        return False

    return seen != meant and go(0, 0)


def token_counts(texts: pa.Array) -> pa.Table:
    """``token, n`` of an array of texts in their one form."""
    counted = pc.value_counts(pc.utf8_split_whitespace(texts).flatten())
    return pa.table({"token": counted.field("values"), "n": counted.field("counts")})


def words_of_tokens(tokens: pa.Table) -> pa.Table:
    """``palavra, n`` of ``token, n``: what is left without punctuation at the ends, in lower case; of two characters or more, with a letter."""
    bare = pc.utf8_trim(tokens["token"], characters=ENDS)
    kept = pc.and_(pc.greater(pc.utf8_length(bare), 1), pc.match_substring_regex(bare, r"\p{L}"))
    words = pa.table({"palavra": pc.utf8_lower(bare), "n": tokens["n"]}).filter(kept)
    return words.group_by("palavra").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            yield from words_of_tokens(pa.concat_tables(held)).combine_chunks().to_batches(max_chunksize=10_000)
        held.clear()

    for b in batches:
        held.append(token_counts(plain_texts(b.column(0).drop_null())))
        if sum(map(len, held)) > 1_000_000:
            yield from out()
    yield from out()


def vocabulary(texts: DataFrame) -> DataFrame:
    """All words of a one-column frame of texts, in lower case: ``palavra, n``; a repeated text counts once."""
    return texts.distinct().mapInArrow(_count_words, "palavra string, n long").groupBy("palavra").agg(F.sum("n").alias("n"))


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [m.replace("-", "") == s if "-" in m and "-" not in s else misread_of(s, m) for s, m in zip(b["palavra"], b["correta"])]
        yield from some(b[keep])


def keyed(words: DataFrame) -> DataFrame:
    """``words`` with ``chave``, a hash of the skeleton without hyphens."""
    return words.withColumn("chave", F.xxhash64(skeleton_column(F.replace("palavra", F.lit("-"), F.lit("")))))


def corrections(words: DataFrame, space: Workspace) -> DataFrame:
    """``palavra, correta``: the misread words of a vocabulary and compounds written without their hyphen.

    Of the words with one skeleton the most frequent made of letters alone is the target (the first in
    order on a tie); others are corrected if they are rarer by TIMES and differ by confusions alone.
    ``words`` is a written table of ``keyed`` words: it is read, not worked out, for each of the joins.
    """
    right = words.where((F.col("n") >= LEAST) & F.col("palavra").rlike(r"^[\p{L}µ]+(-[\p{L}]+)*$"))
    targets = space.write(right.groupBy("chave").agg(F.max(F.struct("n", F.col("palavra").alias("w"))).alias("alvo")))
    near = small(targets)
    seen = words.join(near, "chave").where(f"n * {TIMES} <= alvo.n and palavra <> alvo.w").select("palavra", F.col("alvo.w").alias("correta"))
    compounds = near.where("alvo.w like '%-%'").select(F.replace("alvo.w", F.lit("-"), F.lit("")).alias("junta"), F.col("alvo.w").alias("correta"), F.col("alvo.n").alias("vezes"))
    as_one = words.join(compounds, F.col("junta") == F.col("palavra")).where(f"n * {TIMES} > vezes").select("junta")
    unhyphened = compounds.join(as_one, "junta", "left_anti").select(F.col("junta").alias("palavra"), "correta")
    return seen.union(unhyphened).distinct().mapInPandas(_confirm, "palavra string, correta string")


def compounds_at_breaks(breaks: DataFrame, words: DataFrame, space: Workspace) -> DataFrame:
    """``palavra, correta``: the words broken over a line (``a\\nb``) that the vocabulary has as ``a-b`` more often than as ``ab``."""
    hyphenated = words.where("palavra like '%-%'").select(F.col("palavra").alias("correta"), F.col("n").alias("com"))
    forms = space.write(breaks.withColumn("correta", F.replace("palavra", F.lit("\n"), F.lit("-"))))
    known = space.write(hyphenated.join(small(forms), "correta").withColumn("junta", F.replace("palavra", F.lit("\n"), F.lit(""))))
    joined = words.select(F.col("palavra").alias("junta"), F.col("n").alias("sem")).join(small(known.select("junta").distinct()), "junta", "left_semi")
    return known.join(joined, "junta", "left").where("com > coalesce(sem, 0)").select("palavra", "correta")


# ---- headers


def breaks_of(lines: list[str]) -> set[str]:
    """The words that may be broken over the line ends, as ``a\\nb``: what follows may stand after a header and a page number."""
    out = set()
    for i, line in enumerate(lines):
        if BROKEN_RE.search(line[-2:]):
            out |= {break_key(line[:-1], after) for after in lines[i + 1 : i + 4] if LETTERS_RE.match(after)}
    return out


def break_key(left: str, right: str) -> str:
    return f"{core(left.rpartition(' ')[2])}\n{core(right.partition(' ')[0])}"


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text a hash; of its different folded lines the hashes; the lines long enough for a header, with hash and numbers; and its breaks."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string())]
    for b in batches:
        columns: list[list] = [[] for _ in kinds]
        for report, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lines = [s for line in plain(text).split("\n") if (s := line.strip())]
            own: dict[str, str] = {}
            for line in lines:
                if f := fold(line):
                    own.setdefault(f, line)
            marks = {f: xxhash.xxh64_intdigest(f) - (1 << 63) for f in own}
            long = [f for f in own if len(f) >= HEADER_LETTERS]
            row = (report, xxhash.xxh64_intdigest(text) - (1 << 63), list(marks.values()), [marks[f] for f in long], long, [" ".join(NUMBERS_RE.findall(own[f])) for f in long], list(breaks_of(lines)))
            for column, value in zip(columns, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["r", "t", "todas", "marca", "linha", "numeros", "quebras"])


LINES = "r string, t long, todas array<long>, marca array<long>, linha array<string>, numeros array<string>, quebras array<string>"


def different(texts: DataFrame) -> DataFrame:
    """``g, n``: of ``g, t, outras`` how many texts ``t`` each group has, where copies count as one.

    A text is a copy, exact or revised, if one in COPY_LINES of its lines ``outras`` stands in another text of the group too.
    """
    beside = texts.select("g", "t", F.explode("outras").alias("h"))
    again = beside.groupBy("g", "h").agg(F.count("*").alias("vezes")).where("vezes > 1")
    shared = beside.join(again, ["g", "h"]).groupBy("g", "t").agg(F.count("*").alias("comuns"))
    told = texts.join(shared, ["g", "t"], "left").withColumn("copia", F.coalesce("comuns", F.lit(0)) * COPY_LINES >= F.size("outras"))
    return told.groupBy("g").agg((F.count_if(~F.col("copia")) + F.max(F.col("copia").cast("int"))).alias("n"))


def lines_of_units(units: DataFrame) -> DataFrame:
    """The lines of the different texts of several lines of each report: a row of ``LINES`` per text."""
    return units.where(F.col("texto").contains("\n")).select(report_key(), "texto").distinct().mapInArrow(_lines_of, LINES)


def report_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "relatorio"), F.lit("")).alias("r")


def headers(units: DataFrame, lines: DataFrame | None = None, space: Workspace | None = None) -> DataFrame:
    """``relatorio, cabecalhos array<struct<linha, numeros>>, ultima_pagina``: per report its running headers.

    ``units``: ``relatorio, pagina, chave, texto``; ``lines``: their ``lines_of_units`` as a written table.
    A header is a line, folded, that repeats in HEADER_UNITS different texts and HEADER_SHARE of the
    report's different texts of several lines; ``numeros`` are the numbers that belong to it. Repeated
    deliveries, copies under other keys and revised copies count once.
    """
    space = space or Workspace(units.sparkSession)
    lines = space.write(lines_of_units(units)) if lines is None else lines
    marks = lines.select(F.xxhash64("r").alias("g"), F.explode("marca").alias("marca"))
    whole = different(lines.select(F.xxhash64("r").alias("g"), "t", F.col("todas").alias("outras"))).withColumnRenamed("n", "varias")
    enough = lambda n: (F.col(n) >= HEADER_UNITS) & (F.col(n) >= HEADER_SHARE * F.col("varias"))
    often = space.write(marks.groupBy("g", "marca").agg(F.count("*").alias("vezes")).where(F.col("vezes") >= HEADER_UNITS).join(whole, "g").where(enough("vezes")))
    each = lines.select("r", F.xxhash64("r").alias("g"), F.explode(F.arrays_zip("marca", "linha", "numeros")).alias("x")).select("r", "g", "x.*").join(small(often), ["g", "marca"])
    per = each.groupBy("r", "marca", "linha", "varias", "numeros").agg(F.count("*").alias("n"))
    likely = space.write(per.groupBy("r", "marca", "linha", "varias").agg(F.max(F.struct("n", F.negative(F.length("numeros")).alias("curto"), "numeros"))["numeros"].alias("numeros")))
    candidates = likely.groupBy("r").agg(F.collect_set("marca").alias("candidatas"))
    at = lines.select("r", "t", "todas").join(candidates, "r").select("r", "t", "todas", F.explode(F.array_intersect("todas", "candidatas")).alias("marca"))
    around = different(at.select(F.xxhash64("r", "marca").alias("g"), "t", F.array_remove("todas", F.col("marca")).alias("outras")))
    kept = likely.withColumn("g", F.xxhash64("r", "marca")).join(around, "g").where(enough("n")).groupBy("r").agg(F.collect_list(F.struct("linha", "numeros")).alias("cabecalhos"))
    last = units.groupBy("relatorio").agg(F.max("pagina").alias("ultima_pagina"))
    found = space.write(last.withColumn("r", report_key()).join(kept, "r", "left").select("relatorio", "cabecalhos", "ultima_pagina"))
    space.drop(often, likely)
    return found


# ---- repair of one text


class Header(dict):
    """The folded headers of a report with their numbers; a line looked up once is remembered."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.told: dict[str, str | None] = {}

    def find(self, folded: str) -> str | None:
        if folded not in self.told:
            if len(self.told) > 10_000:
                self.told.clear()
            self.told[folded] = same_header(folded, self)
        return self.told[folded]


def join_lines(text: str, page: int | None, last: int | None, header: dict[str, str], lexicon: dict[str, str] | None = None) -> tuple[str, set[str]]:
    """The text without headers and page numbers, its lines joined; and the kinds of damage met.

    ``lexicon``: of the words broken over lines, ``a\\nb``, those that have a hyphen. Other words are
    joined without, but for a capital after the break.
    """
    if "\n" not in text:
        return text, set()
    kinds: set[str] = set()
    header = header if isinstance(header, Header) else Header(header)

    def is_page(number: str, marked: bool) -> bool:
        n = int(number)
        if page:
            return n in (page, page + 1)
        return marked or n <= (last or 0) + 1

    kept = []
    for line in text.split("\n"):
        s = line.strip()
        if s and header and len(f := fold(s)) >= HEADER_LETTERS and (h := header.find(f)):
            kinds.add("cabecalho")
            own, others = header[h].split(), re.findall(r"\d+", s)
            for n in own:
                if n in others:
                    others.remove(n)
            if any(is_page(n, True) for n in others):
                kinds.add("numero_pagina")
            continue
        if DIGIT_RE.search(s) and not LONG_WORD_RE.search(s) and (m := PAGE_RE.fullmatch(s)) and is_page(m.group(1), not s.isdigit()):
            kinds.add("numero_pagina")
            continue
        kept.append(s)
    out: list[str] = []
    gap = False
    for s in kept:
        if not s:
            gap = True
            continue
        if not out:
            out.append(s)
        elif BROKEN_RE.search(out[-1][-2:]) and LETTERS_RE.match(s):
            kinds.add("hifen")
            left, right = out[-1][:-1], s
            capital = right[0].isupper() and not left.rpartition(" ")[2].isupper()
            out[-1] = left + ("-" if capital or (lexicon and break_key(left, right) in lexicon) else "") + right
        else:
            out[-1] += ("\n\n" if gap else " ") + s
        gap = False
    return "".join(out), kinds


def as_cased(fixed: str, seen: str) -> str:
    if seen.isupper() and len(seen) > 1:
        return fixed.upper()
    return fixed[:1].upper() + fixed[1:] if seen[:1].isupper() else fixed


def fix_word(token: str, lexicon: dict[str, str]) -> tuple[str, bool]:
    """The token put right, and whether a misread character was in it."""
    w = core(token)
    fixed = lexicon.get(w)
    misread = fixed is not None and fixed.replace("-", "") != w
    if fixed is None and SIGN_RE.search(w) and re.search(r"[^\W\d_]{2}", w) and "." not in w:
        fixed, misread = SIGN_RE.sub(lambda m: SIGNS[m.group()], w), True
    if fixed is None and (m := INSIDE_RE.fullmatch(w)):
        fixed, misread = m.group(1) + READ_AS[m.group(2)] + m.group(3), True
    if fixed is None:
        return token, False
    at = token.lower().find(w)
    return (token[:at] + as_cased(fixed, token[at : at + len(w)]) + token[at + len(w) :] if at >= 0 else fixed), misread


def is_plain(word: str) -> bool:
    """Whether a word is of letters or of figures alone: nothing but the lexicon can change it."""
    return word.isalpha() or FIGURES_RE.fullmatch(word) is not None


class Fixer(dict):
    """Tokens put right, each worked out once: token -> None where it is right, else the right one and whether it was misread."""

    def __init__(self, lexicon: dict[str, str], shared: bool = False) -> None:
        """``shared``: whether the lexicon is that of all texts, not of one."""
        super().__init__()
        self.lexicon, self.shared = lexicon, shared
        self.keys_in_arrow = pa.array(list(lexicon), pa.string()) if lexicon else None

    def __missing__(self, token: str) -> tuple[str, bool] | None:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[token] = None if is_plain(word := token.strip(ENDS)) and word.lower() not in self.lexicon else self.worked_out(token)
        return out

    def worked_out(self, token: str) -> tuple[str, bool] | None:
        fixed, misread = fix_word(token, self.lexicon)
        return None if fixed == token and not misread else (fixed, misread)


def repair(text: str, page: int | None, last: int | None, header: dict[str, str], fixer: Fixer) -> tuple[str, set[str]]:
    """The continuous text, and its kinds of damage."""
    joined, kinds = join_lines(plain(text), page, last, header, fixer.lexicon)
    fixes = {t: x for t in set(joined.split()) if (x := fixer[t]) is not None}
    if fixes:
        if any(misread for _, misread in fixes.values()):
            kinds.add("caractere")
        joined = re.sub(r"\S+", lambda m: fixes[m.group()][0] if m.group() in fixes else m.group(), joined)
    return joined, kinds


# ---- over a table


class Damage:
    """What the repair of a table's texts needs, worked out from all its texts and written."""

    def __init__(self, units: DataFrame, other_texts: DataFrame | None = None) -> None:
        """``units``: ``relatorio, pagina, chave, texto``; ``other_texts``: more texts for the vocabulary."""
        self.space = space = Workspace(units.sparkSession)
        there = units.where("texto is not null")
        texts = there.select("texto") if other_texts is None else there.select("texto").union(other_texts.where("texto is not null"))
        words = space.write(keyed(vocabulary(texts)))
        lines = space.write(lines_of_units(there))
        breaks = lines.select(F.explode("quebras").alias("palavra")).distinct()
        self.headers = headers(there, lines, space)
        self.lexicon = space.write(corrections(words, space).union(compounds_at_breaks(breaks, words, space)))
        space.drop(words, lines)

    def words_to_fix(self) -> dict[str, str] | None:
        """The corrections, or None where they are more than may be broadcast."""
        if self.lexicon.count() > BROADCAST_CORRECTIONS:
            return None
        rows = self.lexicon.toPandas()
        return dict(zip(rows["palavra"], rows["correta"]))


def with_headers(units: DataFrame, found: DataFrame) -> DataFrame:
    """``units`` with the headers of its report, which only texts of several lines need.

    ``found``, a row per report, is broadcast up to BROADCAST_REPORTS rows; beyond, only the texts of
    several lines go through the join.
    """
    h = found.withColumnRenamed("relatorio", "r_cabecalho")
    several = F.coalesce(F.col("texto").contains("\n"), F.lit(False))
    own = F.col("relatorio").eqNullSafe(F.col("r_cabecalho"))
    if found.count() <= BROADCAST_REPORTS:
        return units.join(F.broadcast(h), own & several, "left").drop("r_cabecalho")
    kinds = dict(found.dtypes)
    one = units.where(~several).withColumns({c: F.lit(None).cast(kinds[c]) for c in ("cabecalhos", "ultima_pagina")})
    return one.unionByName(units.where(several).join(h, own, "left").drop("r_cabecalho"))


def _words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, text, page, last, header in zip(b["linha_n"], b["texto"], b["pagina"], b["ultima_pagina"], b["cabecalhos"]):
            if text is not None:
                joined, _ = join_lines(plain(text), None if page != page else page, None if last != last else last, {} if header is None else {x["linha"]: x["numeros"] for x in header})
                own = {core(t) for t in joined.split()} | breaks_of([s for line in plain(text).split("\n") if (s := line.strip())])
                rows += [(key, w) for w in own]
        yield from some(pd.DataFrame(rows, columns=["linha_n", "palavra"]))


def per_unit_fixes(units: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``units`` (with ``linha_n``) with ``correcoes``, each unit's own corrections, by joins alone."""
    words = units.select("linha_n", "texto", "pagina", "ultima_pagina", "cabecalhos").mapInPandas(_words_of, "linha_n long, palavra string")
    own = words.join(lexicon, "palavra").groupBy("linha_n").agg(F.map_from_entries(F.collect_list(F.struct("palavra", "correta"))).alias("correcoes"))
    return units.join(own, "linha_n", "left")


def over_texts(units: DataFrame, damage: Damage, make: Callable[[], Callable], schema: str, broadcast_limit: int | None = None) -> DataFrame:
    """Rows made from the texts of ``relatorio, pagina, chave, texto`` with all that their repair needs.

    ``make()`` is called once per task and gives ``f(keys, texts, mend) -> pyarrow.RecordBatch``, called
    once per batch; ``mend(i)`` are the arguments of ``repair`` for the batch's i-th text, but the text.
    """
    fixes = None if broadcast_limit == 0 else damage.words_to_fix()
    ready = with_headers(units, damage.headers).withColumn("r", report_key())
    if fixes is None:
        numbered = damage.space.write(ready.withColumn("linha_n", F.monotonically_increasing_id()))
        ready, shared = per_unit_fixes(numbered, damage.lexicon), None
    else:
        ready = ready.withColumn("correcoes", F.lit(None).cast("map<string,string>"))
        shared = units.sparkSession.sparkContext.broadcast(fixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer, f, reports, none = Fixer({} if shared is None else shared.value, shared is not None), make(), {}, Header()
        for b in batches:
            keys, names, texts, pages, lasts, cells, own = (b.column(i).to_pylist() for i in range(7))

            def mend(i: int) -> tuple:
                if cells[i] is not None and names[i] not in reports:
                    reports[names[i]] = Header((x["linha"], x["numeros"]) for x in cells[i])
                header = none if cells[i] is None else reports[names[i]]
                return pages[i], lasts[i], header, fixer if shared is not None else Fixer(dict(own[i] or ()))

            yield f(keys, texts, mend)

    return ready.select("chave", "r", "texto", "pagina", "ultima_pagina", "cabecalhos", "correcoes").mapInArrow(run, schema)


def repaired(units: DataFrame, damage: Damage, broadcast_limit: int | None = None) -> DataFrame:
    """``chave, texto, texto_limpo, defeitos array<string>`` for each row of ``relatorio, pagina, chave, texto``.

    Null texts stay null, without damage; empty texts stay empty; repeated rows are repeated. A text
    without a damaged word or line comes back equal, but in the one form of ``canonical``.
    """

    def make() -> Callable:
        def batch(keys: list, texts: list, mend: Callable) -> pa.RecordBatch:
            done = [(None, set()) if t is None else repair(t, *mend(i)) for i, t in enumerate(texts)]
            columns = [pa.array(keys, pa.string()), pa.array(texts, pa.string()), pa.array([x for x, _ in done], pa.string()), pa.array([sorted(k) for _, k in done], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["chave", "texto", "texto_limpo", "defeitos"])

        return batch

    return over_texts(units, damage, make, "chave string, texto string, texto_limpo string, defeitos array<string>", broadcast_limit)


def defects(units: DataFrame, damage: Damage) -> DataFrame:
    """``chave, defeito``: the kinds of damage of each row that has any, by the same repair as ``repaired``."""

    def make() -> Callable:
        def batch(keys: list, texts: list, mend: Callable) -> pa.RecordBatch:
            rows = [(k, d) for i, (k, t) in enumerate(zip(keys, texts)) if t is not None for d in sorted(repair(t, *mend(i))[1])]
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.string()) for j in (0, 1)], ["chave", "defeito"])

        return batch

    return over_texts(units, damage, make, "chave string, defeito string")
