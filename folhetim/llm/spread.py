"""Where rows are: small inputs shared out over the cores, and tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folhetim.session import ensure_checkpoint_dir

#: Spark's own setting to remove the shuffle files of a query at its end.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables of keys and counts with so many rows or fewer are broadcast: some 20 MB.
BROADCAST_ROWS = 500_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores; as it is where it has them already.

    Large tables have more partitions than that, so nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have * 2 >= cores else df.repartition(cores)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries run inside leave no shuffle files: what they made is written, nothing reads the files again."""
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


class Workspace:
    """The tables of one job in the shared folder.

    A written table cuts the lineage of what is read from it, so a lost executor costs the tasks that it
    ran. It is dropped after its last use, and so are the shuffle files behind it; what the job's result
    reads stays until the shared folder is emptied.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/mesa-{uuid.uuid4().hex}"
        self.tables: dict[int, tuple[DataFrame, str]] = {}
        self.made = 0

    def write(self, df: DataFrame, random: bool = False) -> DataFrame:
        """``df`` as a table, read again; ``random``: of hashes, which no dictionary or strong compression makes smaller."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        with shuffles_removed(self.spark):
            df.write.options(**({"compression": "snappy", "parquet.enable.dictionary": "false"} if random else {"compression": "zstd"})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that ``write`` returned; nothing unwritten may depend on them any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            _, path = self.tables.pop(id(df))
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared folder, read again."""
    return Workspace(df.sparkSession).write(df)


def small(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has ``limit`` rows or fewer; joined by shuffle if it has more."""
    return F.broadcast(table) if table.count() <= limit else table


def is_empty(table: DataFrame) -> bool:
    """Whether a written table has no rows."""
    return table.limit(1).count() == 0


def some(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """``df`` if it has rows: a frame without rows has no types for Arrow to go by."""
    if len(df):
        yield df
