"""Text that was decoded with the wrong character encoding (problem 10).

Method: every chain of wrong decodings that could have made a line is undone, and each candidate is
compressed with a zstandard dictionary of the document's language. The chain of the least description
length, its own cost included, is chosen; the line stays as it is where no chain pays.

The dictionaries are made from a bounded sample of clean documents (SAMPLE, a parameter). Everything
else reads all documents: a class of characters, matched in the JVM, leaves aside the documents that no
chain can change. Narrow plan, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhetim.llm.spread import some

#: About so many documents, those with the least hashes of their key, are looked at for the dictionaries.
SAMPLE = 2_000
DICTIONARY_BYTES = 65_536
#: Bytes that one step of a chain costs.
STEP_BYTES = 2
#: Chains have at most so many steps.
STEPS = 3

# Wrong decodings, as (how the bytes were read, what they were).
READ_AS_UTF8 = ("windows", "mac_roman", "cp850", "cp437", "cp1251")
READ_AS_WESTERN = ("mac_roman", "cp850", "cp437", "cp1251")
#: Characters of Portuguese, Spanish and English text as it should be; others make a document suspect.
PLAIN = r"\x00-\x7eáàâãäçéêëèíïóôõöúüñÁÀÂÃÇÉÊÍÓÔÕÚÜÑªº°²³µβαγ–—•≥≤±×‘’“”…«»€£§¡¿¹½¼¾\u00a0"
SUSPECT = rf"[^{PLAIN}]|[a-zà-ÿ][À-Þ]|[ÃÂ][^A-Za-zÀ-ÿ\s]|[ÃÂ]\u00a0"
#: Text lost in a decoding that replaced what it could not read.
LOST = r"\ufffd|\p{L}\?+\p{L}|[\x80-\x9f]"
#: Addresses, whose question marks are right.
ADDRESS_RE = re.compile(r"\S*(?:://|www\.|[?&]\w+=)\S*")
LOST_RE = re.compile("\ufffd|[^\\W\\d_]\\?+[^\\W\\d_]|[\x80-\x9f]")
SUSPECT_RE = re.compile(SUSPECT)
RUN_RE = re.compile(r"([^\x00-\x7f]+)")
#: A worker remembers what so many runs of non-ASCII characters become, if they have so few characters.
REMEMBERED, SHORT = 100_000, 16


@lru_cache(1)
def windows_bytes() -> dict[str, int]:
    """cp1252 with the C1 controls where it has no character: it reads any byte, as latin-1 does."""
    out = {chr(b): b for b in range(256)}
    for b in range(128, 160):
        try:
            out[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return out


def to_bytes(run: str, codec: str) -> bytes:
    if codec == "windows":
        table = windows_bytes()
        try:
            return bytes(table[c] for c in run)
        except KeyError as e:
            raise ValueError(codec) from e
    return run.encode(codec)


def is_lost(text: str) -> bool:
    return bool(LOST_RE.search(text)) and bool(LOST_RE.search(ADDRESS_RE.sub(" ", text)))


def undone(run: str, read_as: str, was: str) -> str:
    """A run of non-ASCII characters decoded anew; the run itself where that can't be done."""
    try:
        return to_bytes(run, read_as).decode(was)
    except (ValueError, UnicodeError):
        return run


remembered = lru_cache(REMEMBERED)(undone)


def undo(pieces: list[str], read_as: str, was: str) -> str | None:
    """A text, cut before and after its runs of non-ASCII characters, with each run decoded anew where that can be done; None where no run changes."""
    runs = {r: new for r in {*pieces[1::2]} if (new := (remembered if len(r) <= SHORT else undone)(r, read_as, was)) != r}
    if not runs:
        return None
    return "".join([runs.get(x, x) if i % 2 else x for i, x in enumerate(pieces)])


def candidates(text: str, steps: int = STEPS) -> dict[str, tuple[str, ...]]:
    """Texts that chains lead to, and the shortest chain to each; ``text`` itself has the empty chain."""
    found: dict[str, tuple[str, ...]] = {text: ()}
    front = [text]
    for _ in range(steps):
        ahead = []
        for t in front:
            if not SUSPECT_RE.search(t):
                continue
            options = [(c, "utf-8") for c in READ_AS_UTF8]
            if t == text:
                options += [(c, "cp1252") for c in READ_AS_WESTERN]
            pieces = RUN_RE.split(t)
            for read_as, was in options:
                new = undo(pieces, read_as, was)
                if new is not None and new not in found:
                    found[new] = (*found[t], f"{was}>{read_as}")
                    ahead.append(new)
        front = ahead
    return found


class Restorer:
    """Chooses chains by description length."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.by_language = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(v), write_content_size=False, write_checksum=False, write_dict_id=False) for k, v in dictionaries.items()}

    def cost(self, text: str, language: str | None) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        tools = [self.by_language[language]] if language in self.by_language else list(self.by_language.values())
        return min((len(t.compress(raw)) for t in tools), default=len(raw))

    def weighed(self, text: str, language: str | None) -> list[tuple[str, tuple[str, ...], int]]:
        """What a line may be, by which chain, and the description length without the chain's."""
        options = candidates(text) if SUSPECT_RE.search(text) else {text: ()}
        return [(t, c, self.cost(t, language) if len(options) > 1 else 0) for t, c in options.items()]

    def document(self, text: str, language: str | None) -> tuple[str, str, bool]:
        """The restored text, the chains used, and whether some of it is lost for good."""
        lines = [self.weighed(s, language) for s in text.split("\n")]
        done = [best(x) for x in lines]
        if used := frozenset(c for _, c in done if c):
            done = [best(x, used) for x in lines]
        chains = sorted({"+".join(c) for _, c in done if c})
        whole = "\n".join(s for s, _ in done)
        return whole, " | ".join(chains), is_lost(whole)


def best(options: list[tuple[str, tuple[str, ...], int]], used: frozenset = frozenset()) -> tuple[str, tuple[str, ...]]:
    """The line by its best chain; a chain that the document has ``used`` already costs nothing."""
    return min(options, key=lambda o: (o[2] + (0 if o[1] in used else STEP_BYTES * len(o[1])), o[1] not in used, len(o[1]), o[0]))[:2]


def dictionaries(documents: DataFrame, key: str, text: str, language: str, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary per language of a bounded sample; clean texts alone go in, whole.

    The sample are the documents below a hash that so many are expected under: each partition sends its
    own share, however many partitions there are.
    """
    there = documents.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    part = min(1.0, sample / max(1, there.count()))
    rows = there.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(part * (1 << 30))).select(language, text).collect()
    by: dict[str, list[bytes]] = {}
    for r in rows:
        if not SUSPECT_RE.search(r[text]) and not is_lost(r[text]):
            by.setdefault(r[language], []).append(r[text].encode())
    out = {}
    for k, texts in by.items():
        lines = [s for t in texts for s in t.split(b"\n") if len(s) > 20]
        try:
            out[k] = zstandard.train_dictionary(DICTIONARY_BYTES, lines).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on
            out[k] = b"\n".join(lines)[-DICTIONARY_BYTES:]
    return {k: v for k, v in out.items() if v}


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``key, text, restaurado, cadeias, perdido`` of the documents that are garbled, wholly or in part.

    ``restaurado`` is the text with all recoverable stretches restored, ``cadeias`` the chains undone,
    ``perdido`` whether a decoding lost characters. Null and empty texts are not garbled; repeated rows
    are repeated; a null language is tried as all of them.
    """
    tools = documents.sparkSession.sparkContext.broadcast(dictionaries(documents, key, text, language, sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(tools.value)
        for b in batches:
            done = [restorer.document(t, lang) for t, lang in zip(b["text"], b["lang"])]
            out = pd.DataFrame({"chave": b["chave"], "text": b["text"], "restaurado": [x[0] for x in done], "cadeias": [x[1] for x in done], "perdido": [x[2] for x in done]})
            yield from some(out[(out["cadeias"] != "") | out["perdido"]])

    kind = dict(documents.dtypes)[key]
    suspect = documents.where(F.col(text).rlike(f"{SUSPECT}|{LOST}")).select(F.col(key).alias("chave"), F.col(text).alias("text"), F.col(language).alias("lang"))
    return suspect.mapInPandas(run, f"chave {kind}, text string, restaurado string, cadeias string, perdido boolean").withColumnRenamed("chave", key)
