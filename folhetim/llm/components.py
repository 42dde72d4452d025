"""Connected components of links between records, without collecting links anywhere.

Alternating large-star and small-star steps (published as a map-reduce method): each step replaces the
links of a node by links to the least node near it, and ends when no link changes. Hubs are harmless: a
node's least neighbour is found by a partial aggregation, and joined back by a join that Spark splits
where it is skewed. Each round is written to the shared folder, so that a lost executor costs one round
at most, and the round before is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhetim.llm.spread import Workspace


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the least one near it; repeated links may come out."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    near = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``no, classe``: for every node of ``edges`` (``a, b``, any comparable type) the least node of its component.

    Repeated links and links of a node with itself don't matter; no links give no rows; nodes without a
    link to another one have no row.
    """
    space = Workspace(edges.sparkSession)
    now, was = space.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    for _ in range(rounds):
        digest = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if digest == was:
            break
        was, before = digest, now
        now = space.write(small_star(large_star(before)))
        space.drop(before)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return now.select(F.col("a").alias("no"), F.col("b").alias("classe")).union(now.select(F.col("b").alias("no"), F.col("b").alias("classe"))).distinct()
