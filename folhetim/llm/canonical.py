"""One form for texts that look alike (problem 7).

Method: a longest-match transducer over grapheme clusters, compiled once from a mapping that is worked
out and checked for conflicts beforehand. A cluster is a base, any invisible characters and accents
after it; its output is the mapped base composed with the accents. Widths, blanks, invisible characters,
accents and look-alike letters are all rewritten in that one pass.

Only texts that hold a character of the mapping reach Python: a class of characters, matched in the JVM,
decides it. So the cost follows the number of affected texts. Narrow plan, no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts and the Latin letters that they look like. Greek small letters
# that stand for themselves in measures and names (alpha, beta, gamma, mu, ...) are left out.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "ɡ": "g", "ı": "i", "ո": "n", "օ": "o", "ս": "u",
}

#: Characters without width.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb"
#: Blanks other than the ordinary space, line breaks and tabs.
BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Full-width and half-width forms.
WIDTHS = "\uff01-\uffee"
#: Accents as characters of their own.
ACCENTS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
#: The scripts whose letters can stand for Latin ones.
SCRIPTS = "\u0370-\u03ff\u0400-\u052f\u0530-\u058f"

AFFECTED = f"[{INVISIBLE}{BLANKS}{WIDTHS}{ACCENTS}{''.join(LOOK_ALIKES)}]"

#: A class of few ranges that holds AFFECTED, for the JVM: what is not plain text of these reports.
COARSE = r"[^\x00-\x9f\xa1-\xac\xae-\u0130\u0132-\u0260\u0262-\u02ff\u03b1-\u03b8\u2013\u2014\u2020\u2022\u20ac\u2264\u2265]"


def members(chars: str) -> list[str]:
    """The characters of a class written with ranges."""
    return [chr(c) for a, b in re.findall(r"(.)(?:-(.))?", chars, re.S) for c in range(ord(a), ord(b or a) + 1)]


@lru_cache(1)
def mapping() -> dict[str, str]:
    """The precomputed mapping of single characters.

    Raises ValueError where a character is given two outputs, or an output is itself mapped, so that the
    result can't depend on the order of rules and a second pass changes nothing.
    """
    rules = [(c, "") for c in members(INVISIBLE)] + [(c, " ") for c in members(BLANKS)]
    # Unicode gives a form of another width as '<wide>' or '<narrow>' and the number of the usual one
    forms = [(c, unicodedata.decomposition(c).split()) for c in members(WIDTHS)]
    rules += [(c, chr(int(d[1], 16))) for c, d in forms if len(d) == 2 and chr(int(d[1], 16)) not in members(INVISIBLE)] + list(LOOK_ALIKES.items())
    table: dict[str, str] = {}
    for source, target in rules:
        if table.setdefault(source, target) != target:
            raise ValueError(f"{source!r} is mapped to {table[source]!r} and {target!r}")
    if loops := [s for s, t in table.items() if t in table]:
        raise ValueError(f"outputs are mapped again: {loops}")
    return table


class Transducer:
    """The mapping compiled to one automaton that takes the longest cluster at each place."""

    def __init__(self) -> None:
        self.table = mapping()
        mapped = f"{BLANKS}{WIDTHS}{''.join(LOOK_ALIKES)}"
        accented = f"[^\\s{INVISIBLE}{ACCENTS}][{INVISIBLE}]*(?:[{ACCENTS}][{INVISIBLE}]*)+"
        self.cluster = re.compile(f"{accented}|[{mapped}]|[{INVISIBLE}]+|[{ACCENTS}]+")
        #: letters of other scripts that look like no Latin one: a real foreign word has them
        self.foreign = re.compile("[" + "".join(c for c in members(SCRIPTS) if c.isalpha() and c not in LOOK_ALIKES) + "]")
        self.joint = frozenset(members(INVISIBLE) + members(ACCENTS))
        self.latin = re.compile("[a-zA-ZÀ-ɏ\uff21-\uff3a\uff41-\uff5a]")
        self.alike = re.compile(f"[{''.join(LOOK_ALIKES)}]")
        self.known: dict[str, str] = {}

    def output(self, match: re.Match) -> str:
        cluster = match.group()
        out = self.known.get(cluster)
        if out is None:
            out = unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in cluster))
            if len(self.known) < 100_000:
                self.known[cluster] = out
        return out

    def foreign_words(self, text: str) -> list[tuple[int, int]]:
        """Where words of another script stand that have look-alikes but no Latin letter."""
        out, end = [], 0
        for m in self.foreign.finditer(text):
            if m.start() >= end:
                start, end = m.start(), m.end()
                while start and (text[start - 1].isalpha() or text[start - 1] in self.joint):
                    start -= 1
                while end < len(text) and (text[end].isalpha() or text[end] in self.joint):
                    end += 1
                word = text[start:end]
                if self.alike.search(word) and not self.latin.search(word):
                    out.append((start, end))
        return out

    def apply(self, text: str) -> str:
        out, at = [], 0
        for start, end in self.foreign_words(text):
            out += [self.cluster.sub(self.output, text[at:start]), text[start:end]]
            at = end
        return "".join([*out, self.cluster.sub(self.output, text[at:])])


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def canonical_text(text: str) -> str:
    return transducer().apply(text)


@F.pandas_udf(StringType())
def _canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(canonical_text, na_action="ignore")


def is_affected(text: Column) -> Column:
    """Whether the text may hold a character of the mapping, decided in the JVM; the transducer decides for good."""
    return text.rlike(COARSE)


def canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the column ``out``: ``text`` in its one form. Null stays null, '' stays ''.

    Texts without a mapped character pass through as they are; the form is a fixed point.
    """
    hit = "__afetado"
    with_hit = df.withColumn(hit, F.when(is_affected(F.col(text)), F.col(text)))
    return with_hit.withColumn(out, F.coalesce(_canonical(F.col(hit)), F.col(text))).drop(hit)


def variants(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys whose text is not in its one form, once each: ``key``.

    Null texts are no case. Only affected rows reach the transducer; it decides.
    """
    hit = df.where(is_affected(F.col(text))).select(key, text)
    return hit.withColumn("__forma", _canonical(F.col(text))).where(F.col("__forma") != F.col(text)).select(key).distinct()
