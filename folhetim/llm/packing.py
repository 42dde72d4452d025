"""Containers of fixed capacity filled with items of varying length (problem 8).

Method: large-item matching. Items above a third of the capacity go at most two to a container: from the
largest down, each is matched with the largest other large item that still fits. Smaller items then
best-fit the gaps that remain, largest first, and open new containers when no gap takes them.

The plan is made over the number of items of each size, never over items: there are at most as many
sizes as the capacity has tokens, so the driver gets a table of bounded length and the plan's steps are
runs of equal containers, bounded by the sizes too. Items get their place by rank within their size,
numbered in parallel blocks, so that a size which holds a third of all items is no bottleneck.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folhetim.llm.spread import written

CAPACITY = 4096
#: Items of one size are numbered in blocks of about so many, side by side.
BLOCK_ITEMS = 250_000


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of equal containers: how many, and the sizes in each. ``counts``: items by size, 1 to ``capacity``."""
    left = {s: n for s, n in counts.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    runs: list[list] = []
    while large:
        s = large[-1]
        i = bisect_left(large, capacity - s + 1) - 1
        if i < 0:
            n, mates = left[s], ()
        elif large[i] == s:
            n, mates = left[s] // 2, (s,)
            if not n:
                below = i - 1
                n, mates = 1, ((large[below],) if below >= 0 else ())
        else:
            n, mates = min(left[s], left[large[i]]), (large[i],)
        runs.append([n, (s, *mates)])
        for x in (s, *mates):
            left[x] -= n
            if not left[x]:
                del left[x]
                large.remove(x)
    # gaps: by their width, runs of containers
    gaps: dict[int, list[list]] = defaultdict(list)
    widths: list[int] = []

    def put(n: int, sizes: tuple[int, ...]) -> None:
        gap = capacity - sum(sizes)
        if gap not in gaps or not gaps[gap]:
            insort(widths, gap)
        gaps[gap].append([n, sizes])

    for n, sizes in runs:
        put(n, sizes)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(widths, s)
            if i == len(widths):
                fit = capacity // s
                whole = n // fit
                if whole:
                    put(whole, (s,) * fit)
                if n % fit:
                    put(1, (s,) * (n % fit))
                break
            gap = widths[i]
            run = gaps[gap].pop()
            if not gaps[gap]:
                widths.pop(i)
            fit = min(gap // s, n)
            here = min(run[0], n // fit)
            if run[0] > here:
                put(run[0] - here, run[1])
            put(here, run[1] + (s,) * fit)
            n -= here * fit
    return [(n, sizes) for g in sorted(gaps) for n, sizes in gaps[g]]


def ranked(items: DataFrame, key: str, size: str, blocks: int) -> DataFrame:
    """``items`` with ``posto``, a number from 0 within its size, counted in so many blocks side by side."""
    blocked = items.withColumn("bloco", F.pmod(F.xxhash64(key), F.lit(blocks)))
    sizes = blocked.groupBy(size, "bloco").count()
    before = Window.partitionBy(size).orderBy("bloco").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("antes", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy(size, "bloco").orderBy(key, "parte")
    return blocked.join(offsets, [size, "bloco"]).withColumn("posto", F.col("antes") + F.row_number().over(own) - 1).drop("bloco", "antes")


def pieces_of(sized: DataFrame, capacity: int) -> DataFrame:
    """Items cut into parts of at most the capacity: ``..., parte, tamanho``; items of no tokens have no part.

    All parts of an item that exceeds the capacity but its last fill a container each.
    """
    parts = F.when(F.col("tokens") > 0, F.ceil(F.col("tokens") / capacity)).otherwise(0).cast("int")
    many = sized.where("tokens > 0").withColumn("partes", parts)
    cut = many.withColumn("parte", F.explode(F.sequence(F.lit(1), F.col("partes"))))
    return cut.withColumn("tamanho", F.when(F.col("parte") < F.col("partes"), F.lit(capacity)).otherwise(F.col("tokens") - (F.col("partes") - 1) * capacity).cast("int"))


def pack(sized: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, parte, partes, inicio, tamanho, recipiente``: each item's container, numbered from 0.

    ``sized``: ``key`` and ``tokens``; the key must not repeat. An item above the capacity is split into
    parts from token ``inicio`` on; no other is. Null texts and empty ones, of 0 tokens, are in none.
    """
    parts = written(pieces_of(sized.select(key, "tokens"), capacity))
    counts = {r["tamanho"]: r["count"] for r in parts.groupBy("tamanho").count().collect()}
    spark = sized.sparkSession
    rows, taken, first = [], defaultdict(int), 0
    for n, sizes in plan_containers(counts, capacity):
        each: dict[int, int] = defaultdict(int)
        for s in sizes:
            each[s] += 1
        for s, k in each.items():
            rows.append((s, taken[s], taken[s] + n * k, k, first))
            taken[s] += n * k
        first += n
    steps = spark.createDataFrame(rows, "t int, de long, ate long, por int, primeiro long")
    # a size's steps are few: they are found by the size and the item's rank
    ordered = steps.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("ate", "de", "por", "primeiro"))).alias("passos"))
    placed = ranked(parts, key, "tamanho", -(-max(counts.values(), default=1) // BLOCK_ITEMS)).join(F.broadcast(ordered), F.col("tamanho") == F.col("t"))
    step = placed.withColumn("p", F.try_element_at(F.filter("passos", lambda p: (p["ate"] > F.col("posto")) & (p["de"] <= F.col("posto"))), F.lit(1)))
    at = F.col("p.primeiro") + F.floor((F.col("posto") - F.col("p.de")) / F.col("p.por"))
    return step.select(key, "parte", "partes", ((F.col("parte") - 1) * capacity).cast("long").alias("inicio"), "tamanho", at.cast("long").alias("recipiente"))


def over_several(placed: DataFrame, key: str) -> DataFrame:
    """The items whose parts ``pack`` put into more than one container: ``key``."""
    return placed.groupBy(key).agg(F.min("recipiente").alias("de"), F.max("recipiente").alias("ate")).where("de <> ate").select(key)


def violations(sized: DataFrame, placed: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """One row of counts that are 0 in a right packing: containers too full or left out, items split needlessly, tokens lost."""
    loads = placed.groupBy("recipiente").agg(F.sum("tamanho").alias("carga"))
    full = loads.agg(F.count_if(F.col("carga") > capacity).alias("acima"), (F.coalesce(F.max("recipiente") + 1, F.lit(0)) - F.count("*")).alias("vazios"))
    items = placed.groupBy(key).agg(F.sum("tamanho").alias("postos"), F.max("partes").alias("partes"))
    each = sized.select(key, "tokens").join(items, key, "left").agg(F.count_if((F.col("partes") > 1) & (F.col("tokens") <= capacity)).alias("cortados"), F.coalesce(F.sum(F.col("tokens") - F.coalesce("postos", F.lit(0))), F.lit(0)).alias("perdidos"))
    return full.join(F.broadcast(each))
