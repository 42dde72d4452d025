"""Texts as bags of words, after the repair of problems 4 and 7.

A word is a piece between white space, in lower case, without punctuation or symbols at its ends. A bag
is an ordered row of 64-bit hashes in which the k-th occurrence of a word counts as a word of its own,
so that the intersection of two bags as sets counts repeated words right. It travels as one binary value.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhetim.llm.descan import ENDS, Damage, Fixer, join_lines, over_texts, plain_texts

#: A record: its bag's 128-bit print, size, a map of 256 bits with the bit of each word set, and the bag, packed.
RECORD = "chave string, impressao binary, n int, m0 long, m1 long, m2 long, m3 long, palavras binary"

#: A word with a letter or a figure at either end; one that ``fix_word`` may change without the lexicon.
WHOLE = r"^[\p{L}\p{N}](?s:.*[\p{L}\p{N}])?$"
MAY_BE_MISREAD = r"[@€†¢]|^\D{2,}[01569!|]\D{2,}$"


def bare(token: str) -> str:
    """A token in lower case, without punctuation and symbols at its ends."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum() and unicodedata.category(token[a])[0] in "PS":
        a += 1
    while b > a and not token[b - 1].isalnum() and unicodedata.category(token[b - 1])[0] in "PS":
        b -= 1
    return token[a:b].lower()


def words(text: str) -> list[str]:
    return [w for t in text.split() if (w := bare(t))]


def word_hashes(tokens: pa.Array, fixer: Fixer | None = None) -> np.ndarray:
    """The hashes of the words that tokens are, put right by ``fixer``; 0 where no word is left."""
    words = pc.utf8_trim(tokens, characters=ENDS)
    # with letters or figures at its ends a word is bare; nothing but the lexicon can change one without a sign or a single figure among letters
    odd = pc.invert(pc.match_substring_regex(words, WHOLE))
    words = pc.utf8_lower(words)
    fixable = pc.and_(odd, pc.invert(odd)) if fixer is None else pc.match_substring_regex(words, MAY_BE_MISREAD)
    if fixer is not None and fixer.keys_in_arrow is not None:
        fixable = pc.or_(fixable, pc.is_in(words, value_set=fixer.keys_in_arrow))
    odd = pc.or_(odd, fixable)
    words = words.to_numpy(zero_copy_only=False)
    for i, token, may in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)), tokens.filter(odd).to_pylist(), fixable.filter(odd).to_pylist()):
        fixed = fixer.worked_out(token) if may else None
        words[i] = bare(fixed[0] if fixed else token)
    hashes = pd.util.hash_array(words, categorize=False).view(np.int64)
    hashes[pc.equal(pc.binary_length(pa.array(words, pa.string())), 0).to_numpy(zero_copy_only=False)] = 0
    return hashes


def bags_of(texts: list[str], fixer: Fixer | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bags of texts, one after the other, and how many words each has."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
    tokens = split.flatten().dictionary_encode()
    if not len(tokens):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    hashes, place = np.unique(word_hashes(tokens.dictionary, fixer), return_inverse=True)
    # one number for text and word, the words in the order of their hashes
    both = np.repeat(np.arange(len(texts)) << 32, split.value_lengths().to_numpy(zero_copy_only=False)) | place[tokens.indices.to_numpy(zero_copy_only=False)]
    if len(none := np.flatnonzero(hashes == 0)):
        both = both[both & 0xFFFFFFFF != none[0]]
    both.sort()
    sizes = np.bincount(both >> 32, minlength=len(texts))
    return told_apart(hashes[both & 0xFFFFFFFF], sizes), sizes


def bag(text: str) -> np.ndarray:
    return bags_of([text])[0]


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def told_apart(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words of each text, in the order of their hashes as given, the k-th occurrence of a word mixed with k."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = flat.view(np.uint64)
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(out))
    k = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    mixed = (out ^ k * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.where(fresh, out, mixed ^ mixed >> np.uint64(29)).view(np.int64)


def word_maps(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The four words of each bag's map of 256 bits."""
    bit = np.left_shift(np.uint64(1), (flat & 63).astype(np.uint64))
    part = flat >> 6 & 3
    return [np.bitwise_or.reduceat(np.where(part == k, bit, np.uint64(0)), starts).view(np.int64) for k in range(4)]


def packed(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Numbers of 64 bits, so many a row, as one binary value a row."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` made: all numbers, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.int64, (ends[-1] - ends[0]) // 8, ends[0]) if data is not None else np.empty(0, np.int64)), np.diff(ends).astype(np.int64) // 8


def records_of(keys: list[str], flat: np.ndarray, sizes: np.ndarray, least: int = 1, signature: Callable | None = None) -> pa.RecordBatch:
    """A batch of ``RECORD`` of the bags of ``least`` words or more; ``signature(flat, starts)`` adds ``faixas``, an equal number of keys each."""
    enough = sizes >= max(1, least)
    flat, sizes, kept = flat[np.repeat(enough, sizes)], sizes[enough], [k for k, e in zip(keys, enough) if e]
    starts = starts_of(sizes) if kept else sizes
    maps = word_maps(flat, starts) if kept else [flat] * 4
    prints = [xxhash.xxh3_128_digest(flat[s : s + n].tobytes()) for s, n in zip(starts, sizes)]
    columns = {"chave": pa.array(kept, pa.string()), "impressao": pa.array(prints, pa.binary()), "n": pa.array(sizes, pa.int32())}
    columns |= {f"m{k}": pa.array(m, pa.int64()) for k, m in enumerate(maps)} | {"palavras": packed(flat, sizes)}
    if signature is not None:
        found = signature(flat, starts) if kept else np.empty((0, 1), np.int64)
        columns["faixas"] = packed(found.ravel(), np.full(len(kept), found.shape[1]))
    return pa.RecordBatch.from_pydict(columns)


def bags(units: DataFrame, damage: Damage, least: int, signature: Callable | None = None) -> DataFrame:
    """A row of ``RECORD`` for each unit whose repaired text has ``least`` words or more; with ``signature`` also ``faixas binary``.

    ``units``: ``relatorio, pagina, chave, texto``. Null texts and shorter ones have no row. Each text is
    read, repaired and hashed in one pass.
    """

    def make() -> Callable:
        def batch(keys: list, texts: list, mend: Callable) -> pa.RecordBatch:
            # the repair joins words, it makes no more of them
            long = [i for i, t in enumerate(texts) if len(t.split()) >= least]
            needs = [mend(i) for i in long]
            ones = plain_texts(pa.array([texts[i] for i in long], pa.string())).to_pylist()
            whole = [join_lines(t, page, last, header, fixer.lexicon)[0] for t, (page, last, header, fixer) in zip(ones, needs)]
            if needs and not needs[0][3].shared:
                found = [bags_of([t], need[3]) for t, need in zip(whole, needs)]
                flat, sizes = (np.concatenate(x) for x in zip(*found))
            else:
                flat, sizes = bags_of(whole, needs[0][3] if needs else None)
            return records_of([keys[i] for i in long], flat, sizes, least, signature)

        return batch

    schema = RECORD + (", faixas binary" if signature is not None else "")
    return over_texts(units.where(F.col("texto").isNotNull()), damage, make, schema)


def in_common(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many words the bags of two columns have in common, row by row."""
    (a, na), (b, nb) = unpacked(left), unpacked(right)
    row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
    flat = np.concatenate([a, b])
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order]
    twice = (flat[1:] == flat[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][twice], minlength=len(na))


def linked_pairs(pairs: DataFrame, share: float = 0.8) -> DataFrame:
    """``a, b`` of ``a, b, palavras_a, palavras_b`` whose words in common are at least ``share`` of the longer bag, in whole numbers."""
    thousandths = round(share * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("palavras_a"), batch.column("palavras_b")
            longer = np.maximum(unpacked(a)[1], unpacked(b)[1])
            yield batch.select(["a", "b"]).filter(pa.array(in_common(a, b) * 1000 >= longer * thousandths))

    return pairs.select("a", "b", "palavras_a", "palavras_b").mapInArrow(run, "a long, b long")
