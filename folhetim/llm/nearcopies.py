"""Groups of records that are copies with small edits (problem 1).

Method: min-max hashing. Each permutation gives two values of a bag of words, its least and its greatest
hash, so half the hash evaluations make a signature of the same length. Bands of the signature are
bucket keys; texts that share a bucket are compared exactly, word by word; groups are the connected
components of the exact links.

Equal texts (by their bag of words) are one node, so hot copies cost nothing. The members of bands are
shuffled packed, many to a row; sizes of other buckets are counted by a partial aggregation. In a bucket of at most PAIRED nodes all pairs are compared. A larger one is cut
into smaller buckets by an exact prefix filter: linked nodes share one of their first words, rare ones
first. Where even such a bucket is large, every node is compared with the bucket's first, and only those
not linked to it with all others. So a hot bucket of copies costs a pass over it, a hot bucket of texts
that share but a form is cut up, and no pair is given up.

A link at a similarity of exactly 0.8 (a Jaccard index of two thirds) shares none of the 16 bands with a
chance of (1 - (2/3)^3)^16 = 0.4 %; at 0.9 (0.82) it is 1 in 4 million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhetim.llm.components import components
from folhetim.llm.spread import Workspace, is_empty, small
from folhetim.llm.wordsets import linked_pairs, packed, starts_of, unpacked

PERMUTATIONS, ROWS = 24, 3
PAIRED = 1000
#: Words are ordered by how often they occur, counted in so many slots by hash: a table of fixed size.
SLOTS = 1 << 18
#: Members of bands go packed, in so many passes, in shards of about so many; a member is COLUMNS, the last two its word map. So many pairs are looked at at once.
PASSES, SHARD_MEMBERS, PAIRS_AT_ONCE = 2, 250_000, 1_000_000
COLUMNS = ("faixa", "no", "n", "baixa", "alta")


def min_max_bands(flat: np.ndarray, starts: np.ndarray, permutations: int = PERMUTATIONS, rows: int = ROWS) -> np.ndarray:
    """Bucket keys of bags: ``flat`` holds all hashes, ``starts`` where each bag (not empty) begins.

    One row per bag, one column per band. Least and greatest values of different permutations
    alternate within a band.
    """
    rng = np.random.default_rng(20140601)
    mul = rng.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    x = flat.view(np.uint64)
    lows, highs = [], []
    for m, a in zip(mul, add):
        v = x * m + a
        v ^= v >> np.uint64(32)
        lows.append(np.minimum.reduceat(v, starts))
        highs.append(np.maximum.reduceat(v, starts))
    values = [z for i in range(permutations) for z in (lows[i], highs[(i + 1) % permutations])]
    bands = []
    for k in range(len(values) // rows):
        key = np.full(len(starts), (k + 1) * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
        for v in values[k * rows : (k + 1) * rows]:
            key = (key ^ v) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
        bands.append(key)
    return np.stack(bands, axis=1).view(np.int64)


# ---- first words, rare ones first


def word_counts(nodes: DataFrame) -> np.ndarray:
    """How often words occur over all ``palavras``, by slot: SLOTS numbers, whatever the size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(SLOTS, np.int64)
        for b in batches:
            own += np.bincount(unpacked(b.column("palavras"))[0] % SLOTS, minlength=SLOTS)
        there = np.flatnonzero(own)
        for i in range(0, len(there), 10_000):
            part = there[i : i + 10_000]
            yield pa.RecordBatch.from_pydict({"s": pa.array(part, pa.int32()), "n": pa.array(own[part], pa.int64())})

    rows = nodes.select("palavras").mapInArrow(run, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[rows["s"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def first_words(nodes: DataFrame, counts: np.ndarray, share: float, more: int = 0) -> DataFrame:
    """``no, palavra, posicao, n`` and the other columns of ``nodes`` but ``palavras``: the words by which links are found.

    In any one order of all words, bags linked by ``share`` have at least ``more`` + 1 words in common
    among the first n - ceil(share n) + 1 + ``more`` of each. The order is that of ``counts``, then of
    hash; it decides the size of buckets, not the result. ``posicao`` counts from 1.
    """
    order = nodes.sparkSession.sparkContext.broadcast(counts)
    thousandths = round(share * 1000)
    kept = [f for f in nodes.schema.fields if f.name not in ("no", "n", "palavras")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = unpacked(b.column("palavras"))
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            ordered = np.lexsort((flat, order.value[flat % SLOTS], row))
            position = np.arange(len(flat)) - np.repeat(starts_of(sizes), sizes) + 1
            first = position <= (sizes + thousandths * -sizes // 1000 + 1 + more)[row]
            at = pa.array(row[first])
            columns = {"no": b.column("no").take(at), "palavra": pa.array(flat[ordered][first]), "posicao": pa.array(position[first], pa.int32()), "n": pa.array(sizes[row[first]], pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | {f.name: b.column(f.name).take(at) for f in kept})

    schema = "no long, palavra long, posicao int, n int" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)
    return nodes.select("no", "palavras", *[f.name for f in kept]).mapInArrow(run, schema)


# ---- links within buckets


def verified(pairs: DataFrame, nodes: DataFrame, space: Workspace, share: float) -> DataFrame:
    """Of candidate pairs (``a, b``, once each) those linked exactly; a written table.

    The words of the nodes that are in a pair are fetched once.
    """
    pairs = space.write(pairs)
    ids = space.write(pairs.select(F.col("a").alias("no")).union(pairs.select(F.col("b").alias("no"))).distinct())
    near = space.write(nodes.select("no", "palavras").join(small(ids), "no"))
    wa = near.select(F.col("no").alias("a"), F.col("palavras").alias("palavras_a"))
    wb = near.select(F.col("no").alias("b"), F.col("palavras").alias("palavras_b"))
    found = space.write(linked_pairs(pairs.join(wa, "a").join(wb, "b"), share))
    space.drop(pairs, ids, near)
    return found


#: What a pair must meet: lengths that allow the share, and word maps that differ in no more bits than
#: linked bags have words apart. Both follow from the definition of a link, so no link is lost.
MAP = ("n", "m0", "m1", "m2", "m3")
BITS = [f"bit_count(x.m{k} ^ y.m{k})" for k in range(4)]
POSSIBLE = "least(x.n, y.n) * 1000 >= greatest(x.n, y.n) * {t}" + "".join(f" and (x.n + y.n - ({' + '.join(b)})) * 500 >= greatest(x.n, y.n) * {{t}}" for b in (BITS[:2], BITS))
#: One of a pair's members is of the index; of two such members the pair counts once.
INDEXED = "x.indice and (not y.indice or x.no < y.no)"


def shared_buckets(members: DataFrame, maps: DataFrame, space: Workspace) -> DataFrame:
    """The members of buckets that may hold a pair, with the bucket's size ``q`` and the node's MAP; a written table.

    Two rows of a bucket make a pair if one of them, at least, is of the index. ``maps`` is ``no`` and MAP.
    """
    sizes = members.groupBy("faixa").agg(F.count("*").alias("q"), *([F.max("indice").alias("sim")] if "indice" in members.columns else [F.lit(True).alias("sim")]))
    sizes = space.write(sizes.where("q > 1 and sim").drop("sim"))
    found = members.join(small(sizes), "faixa")
    missing = [c for c in MAP if c not in members.columns]
    shared = space.write(found.join(maps.select("no", *missing), "no") if missing else found)
    space.drop(sizes)
    return shared


def pairs_of(x: DataFrame, y: DataFrame, condition: str) -> DataFrame:
    """``a, b``, a < b: the pairs of members of one bucket that meet the condition."""
    both = x.alias("x").join(y.alias("y"), F.expr(f"x.faixa = y.faixa and {condition}"))
    return both.select(F.least("x.no", "y.no").alias("a"), F.greatest("x.no", "y.no").alias("b"))


def candidates(members: DataFrame, nodes: DataFrame, space: Workspace, share: float, paired: int = PAIRED, worth: str = "true", refine: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a, b`` of nodes of one bucket that may be linked, once each, and pairs known to be; written tables.

    ``members``: ``faixa, no``, ``indice`` (without it all are of the index) and what ``worth`` needs, a condition on a pair of members ``x`` and
    ``y`` that leaves out pairs that can't be linked. Pairs without a member of the index are not looked
    for. ``nodes``: ``no, n, m0 to m3, palavras``. ``refine`` cuts large buckets: members to members.
    Every link in a bucket is among the pairs, or its ends are joined through others that are.
    """
    shared = shared_buckets(members, nodes, space)
    can = f"{POSSIBLE.format(t=round(share * 1000))} and ({worth})"
    few = shared.where(F.col("q") <= paired)
    pairs = pairs_of(few.where("indice"), few, f"{INDEXED} and {can}") if "indice" in members.columns else pairs_of(few, few, f"x.no < y.no and {can}")
    large = shared.where(F.col("q") > paired)
    if is_empty(large):
        found, known = space.write(pairs.distinct()), None
    elif refine is not None:
        cut = space.write(refine(large.drop("q")))
        rest, known = candidates(cut, nodes, space, share, paired, worth)
        found = space.write(pairs.union(rest).distinct())
        space.drop(cut, rest)
    else:
        # the bucket's first node of the index against all; what isn't linked to it, against all again
        large = large if "indice" in members.columns else large.withColumn("indice", F.lit(True))
        first = large.where("indice").groupBy("faixa").agg(F.min("no").alias("primeiro"))
        of_first = large.join(first, "faixa")
        pivot = of_first.where("no = primeiro").drop("primeiro")
        known = verified(pairs_of(pivot, large, f"x.no <> y.no and {can}").distinct(), nodes, space, share)
        held = known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        loose = of_first.where("no <> primeiro").join(held, (F.col("primeiro") == F.col("a")) & (F.col("no") == F.col("b")), "left_anti").drop("primeiro")
        others = pairs_of(loose, large, f"x.no <> y.no and (x.indice or y.indice) and {can}")
        found = space.write(pairs.union(others).distinct())
    space.drop(shared)
    return found, known


def bucket_links(members: DataFrame, nodes: DataFrame, space: Workspace, share: float, paired: int = PAIRED, worth: str = "true", refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``a, b``: exact links between nodes that share a bucket, all that the components need. Arguments as of ``candidates``."""
    pairs, known = candidates(members, nodes, space, share, paired, worth, refine)
    links = verified(pairs, nodes, space, share)
    space.drop(pairs)
    return links if known is None else links.union(known)


def by_first_words(nodes: DataFrame, space: Workspace, share: float) -> Callable[[DataFrame], DataFrame]:
    """Cuts buckets by the first words of their members; linked members meet in one at least."""

    def refine(large: DataFrame) -> DataFrame:
        ids = space.write(large.select("no").distinct())
        own = space.write(nodes.select("no", "palavras").join(small(ids), "no"))
        words = first_words(own, word_counts(own), share)
        return large.join(words.select("no", "palavra"), "no").withColumn("faixa", F.xxhash64("faixa", "palavra")).drop("palavra")

    return refine


# ---- pairs that share a band


def in_shards(batches: Iterator[pa.RecordBatch], bands: slice, shards: int) -> Iterator[pa.RecordBatch]:
    """``g`` and COLUMNS, packed: the members of ``bands``, a row for each shard that has some; a bucket is in one shard."""
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held, axis=1)
        held.clear()
        shard = (rows[0].view(np.uint64) >> np.uint64(16)) % np.uint64(shards)
        order, sizes = np.argsort(shard, kind="stable"), np.bincount(shard.astype(np.int64), minlength=shards)
        there = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(packed(c[order], sizes[there]) for c in rows)], ["g", *COLUMNS])

    for b in batches:
        keys, widths = unpacked(b.column("faixas"))
        if not len(keys):
            continue
        keys = keys.reshape(len(widths), -1)[:, bands]
        no, n, *maps = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("no", *MAP))
        each = np.stack([no, n, maps[0] | maps[2], maps[1] | maps[3]])
        held.append(np.concatenate([keys.reshape(1, -1), np.repeat(each, keys.shape[1], axis=1)]))
        if sum(x.shape[1] for x in held) > SHARD_MEMBERS:
            yield from out()
    if held:
        yield from out()


def pairs_in_shard(rows: np.ndarray, share: float, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may be linked of members in the order of their buckets, so many at a time; ``ends``: where each member's bucket ends."""
    thousandths = round(share * 1000)
    _, no, n, *maps = rows
    later = ends - np.arange(len(no)) - 1
    done = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(no):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, "right")) - 1)
        x = np.repeat(np.arange(at, to), later[at:to])
        y = np.arange(len(x)) - np.repeat(done[at:to] - done[at], later[at:to]) + x + 1
        near = np.minimum(n[x], n[y]) * 1000 >= np.maximum(n[x], n[y]) * thousandths
        x, y = x[near], y[near]
        apart = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int64) for m in (maps[0].view(np.uint64), maps[1].view(np.uint64)))
        near = ((n[x] + n[y] - apart) * 500 >= np.maximum(n[x], n[y]) * thousandths) & (no[x] != no[y])
        x, y = no[x[near]], no[y[near]]
        yield np.minimum(x, y), np.maximum(x, y)
        at = to


def band_pairs(nodes: DataFrame, space: Workspace, share: float, paired: int = PAIRED) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of nodes that share a band of ``faixas`` and may be linked, once each; and ``faixa, no``, the members of larger buckets.

    Members travel packed, a row for many of them, as there are 16 a node. The word map of a member is
    folded to 128 bits; the filter is that of POSSIBLE.
    """
    spark = nodes.sparkSession
    width = nodes.select((F.octet_length("faixas") / 8).cast("int").alias("w")).first()
    width = width["w"] if width else PASSES
    shards = max(4 * spark.sparkContext.defaultParallelism, nodes.count() * width // PASSES // SHARD_MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(faixa: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            none = pa.nulls(len(a), pa.int64())
            if len(a):
                yield pa.RecordBatch.from_arrays([none if faixa is None else pa.array(faixa), pa.array(a), none if b is None else pa.array(b)], ["faixa", "a", "b"])

        def without_large(rows: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The members in order of their buckets, the sizes of those, and whether they are large."""
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]])[: rows.shape[1]])
            sizes = np.diff(np.concatenate([starts, [rows.shape[1]]]))
            return rows, sizes, (sizes > paired) | np.isin(rows[0][starts], hot)

        def shard(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            held, hot = [], np.empty(0, np.int64)
            room = 4 * SHARD_MEMBERS
            for part in parts:
                held.append(part)
                if sum(x.shape[1] for x in held) > room:  # the members of large buckets needn't be held
                    rows, sizes, large = without_large(np.concatenate(held, axis=1), hot)
                    of_large = np.repeat(large, sizes)
                    hot = np.union1d(hot, rows[0][of_large])
                    yield from out(rows[0][of_large], rows[1][of_large], None)
                    held = [rows[:, ~of_large]]
                    room = max(room, 2 * held[0].shape[1])
            rows, sizes, large = without_large(np.concatenate(held, axis=1), hot)
            of_large = np.repeat(large, sizes)
            yield from out(rows[0][of_large], rows[1][of_large], None)
            several = np.repeat((sizes > 1) & ~large, sizes)
            sizes = sizes[(sizes > 1) & ~large]
            for a, b in pairs_in_shard(rows[:, several], share, np.repeat(np.cumsum(sizes), sizes)):
                yield from out(None, a, b)

        def parts() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                columns = [unpacked(b.column(c)) for c in COLUMNS]
                ends = np.cumsum(columns[0][1])
                rows = np.stack([x for x, _ in columns])
                for g, start, end in zip(b.column("g").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    yield g, rows[:, start:end]

        for _, own in groupby(parts(), itemgetter(0)):
            yield from shard(x for _, x in own)

    found = []
    for k in range(PASSES):  # not all bands at once, for the disk
        bands = slice(k * width // PASSES, (k + 1) * width // PASSES)
        members = nodes.select("no", *MAP, "faixas").mapInArrow(lambda it, bands=bands: in_shards(it, bands, shards), "g int, " + ", ".join(f"{c} binary" for c in COLUMNS))
        found.append(space.write(members.repartition("g").sortWithinPartitions("g").mapInArrow(run, "faixa long, a long, b long")))
    every = reduce(DataFrame.union, found)
    pairs = space.write(every.where("b is not null").select("a", "b").distinct())
    large = space.write(every.where("b is null").select("faixa", F.col("a").alias("no")))
    space.drop(*found)
    return pairs, large


def copy_links(nodes: DataFrame, space: Workspace, share: float = 0.8, paired: int = PAIRED) -> DataFrame:
    """``a, b``: links between nodes that share a band of ``faixas``, all that the components need."""
    pairs, large = band_pairs(nodes, space, share, paired)
    if is_empty(large):
        return verified(pairs, nodes, space, share)
    cut = space.write(by_first_words(nodes, space, share)(large))
    rest, known = candidates(cut, nodes, space, share, paired)
    links = verified(pairs.union(rest).distinct(), nodes, space, share)
    space.drop(cut, rest, pairs, large)
    return links if known is None else links.union(known)


# ---- records and nodes


class Nodes:
    """One node for each different bag of the records: ``nodes``, ``no`` and the bag's columns; and who has it.

    A bag's node is one of its rows. The rows of bags that came again are told apart by their numbers
    alone, and the words are not moved for it.
    """

    def __init__(self, records: DataFrame, space: Workspace) -> None:
        self.rows = rows = space.write(records.withColumn("no", F.monotonically_increasing_id()), random=True)
        prints = rows.groupBy("impressao").agg(F.min("no").alias("primeiro"), F.count("*").alias("q")).where("q > 1").drop("q")
        self.again = space.write(rows.select("no", "impressao").join(prints, "impressao").select("no", "primeiro"))
        self.again_small = small(self.again)
        self.nodes = rows.join(self.again_small.where("no <> primeiro").select("no"), "no", "left_anti")
        keys = self.member().groupBy("chave").agg(F.min("no").alias("de"), F.max("no").alias("ate")).where("de <> ate")
        self.several = space.write(keys.select(F.col("chave").alias("c"), F.col("de").alias("b")))

    def member(self) -> DataFrame:
        """``chave, no``: the node of each record's row."""
        return self.rows.select("chave", "no").join(self.again_small, "no", "left").select("chave", F.coalesce("primeiro", "no").alias("no"))

    def same_key_links(self) -> DataFrame:
        """``a, b``: links between the nodes of a key that came with different bags."""
        return self.member().join(small(self.several), F.col("chave") == F.col("c")).where("no <> b").select(F.col("no").alias("a"), "b").distinct()

    def classes(self, links: DataFrame, space: Workspace) -> DataFrame:
        """``chave, c``: the component, by its least node, of each key whose bag is linked or came again; a written table."""
        found = components(links.union(self.same_key_links()))
        alone = self.again.select(F.col("primeiro").alias("no")).distinct().join(found, "no", "left_anti").select("no", F.col("no").alias("classe"))
        classes = space.write(found.union(alone))
        return space.write(self.member().join(small(classes), "no").select("chave", F.col("classe").alias("c")).distinct())


def grouped(records: DataFrame, share: float = 0.8, paired: int = PAIRED) -> DataFrame:
    """``chave, classe, exemplares``: for each record with a copy its class and the class's number of records.

    ``records``: ``wordsets.RECORD`` and ``faixas``, by ``min_max_bands``. A class is named by its least
    key. Records with equal bags are copies; a key that came with different bags joins their classes;
    repeated rows count once. Records without a copy have no row; no records give no rows.
    """
    space = Workspace(records.sparkSession)
    known = Nodes(records, space)
    links = copy_links(known.nodes, space, share, paired)
    named = known.classes(links, space)
    sizes = named.groupBy("c").agg(F.count("*").alias("exemplares"), F.min("chave").alias("classe")).where("exemplares > 1")
    return named.join(sizes, "c").select("chave", "classe", "exemplares")


def pairs_within(groups: DataFrame, table_of: F.Column) -> DataFrame:
    """``id_a, id_b``: all pairs of different records of a class and a table, ``id_a < id_b``.

    TESTDATA.md fixes this form; it is as large as the squares of the classes. ``grouped`` is the linear one.
    """
    g = groups.select("classe", "chave", table_of.alias("tabela"))
    return (
        g.select("classe", "tabela", F.col("chave").alias("id_a"))
        .join(g.select("classe", "tabela", F.col("chave").alias("id_b")), ["classe", "tabela"])
        .where("id_a < id_b")
        .select("id_a", "id_b")
    )
