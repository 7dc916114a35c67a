"""Joins to tables of one row a key whose memory follows neither Spark's guess nor a hub.

Spark takes the bytes of compressed files, or of the rows that an Arrow function starts from, for
the size of a table, so it may broadcast one of millions of rows through the driver.  Here a
table is told to every task only if its rows were counted first.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeflow.storage import Saved

#: Rows of a table that every task may be told, and rows of a key from which on it may be a hub, at least.
SMALL, HUB = 1 << 18, 1 << 14
#: Bits of a sieve for each key that it is made of, and at most (8 MB, which every task is told).
SIEVE, MOST_BITS = 32, 1 << 26
#: Rows of a partition that a shuffle makes, about, and bytes of a saved table that a task reads at most.
SHARE, READ = 1 << 20, 16 << 20


@contextmanager
def shares(spark: SparkSession, rows: int):
    """While it lasts, shuffles have a partition for every ``SHARE`` of ``rows``, so a task's part of them does not grow with the input.

    It takes effect on what is planned inside; the session has its own settings back afterwards.
    """
    parts, read = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    own = {k: spark.conf.get(k) for k in (parts, read)}
    spark.conf.set(parts, max(int(own[parts]), -(-rows // SHARE)))
    spark.conf.set(read, str(min(_bytes(own[read]), READ)))
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def _bytes(size: str) -> int:
    """A setting such as ``128m`` or ``134217728b``."""
    size = size.strip().lower().removesuffix("b")
    unit = "kmgtp".find(size[-1]) + 1
    return int(size[:-1] if unit else size) << 10 * unit


def told(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table`` as one side of a join: broadcast if it is known to have few ``rows``, shuffled otherwise."""
    return F.broadcast(table) if rows is not None and rows <= SMALL else table.hint("merge")


def hub_limit(df: DataFrame, rows: int) -> int:
    """Rows of a key that are a quarter of a partition's even share: at most four keys a partition have so many."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(HUB, rows // (4 * parts))


def hubs(df: DataFrame, key: str, rows: int) -> Saved:
    """The few keys that very many of ``df``'s rows share."""
    return Saved(df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= hub_limit(df, rows)).select(key))


def looked_up(df: DataFrame, table: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """``df`` joined to ``table``, which has a row a key: the rows of ``heavy`` keys stay in place, the rest is shuffled."""
    few = F.broadcast(heavy.select(key))
    there = df.join(F.broadcast(table.join(few, key, "left_semi")), key)
    return there.unionByName(df.join(few, key, "left_anti").join(told(table), key))


def sieve(keys: DataFrame, rows: int):
    """A function of a table and a hash: the rows that may be among the ``rows`` hashes in the only column of ``keys``, and those that are not.

    No row that is among them is ever taken for one that is not, nor is one lost: a null hash is like 0.  What is left out of a join so
    need not be shuffled for it.  The bitmap is bounded; once it is full nothing is left out.
    """
    bits = min(MOST_BITS, 1 << max(15, (SIEVE * rows).bit_length()))
    place = lambda h: F.pmod(F.coalesce(h, F.lit(0)), F.lit(bits)) + 1
    at = keys.select(place(F.col(keys.columns[0])).alias("at"))
    held = at.groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    held = Saved(held)

    def parts(df: DataFrame, h) -> tuple[DataFrame, DataFrame]:
        marked = df.withColumn("__at", place(h)).withColumn("__bucket", F.bitmap_bucket_number("__at")).join(F.broadcast(held.df), "__bucket", "left")
        byte = "conv(hex(substring(__bits, cast(bitmap_bit_position(__at) div 8 + 1 as int), 1)), 16, 10)"
        may = F.coalesce(F.expr(f"getbit(cast({byte} as bigint), cast(bitmap_bit_position(__at) % 8 as int)) = 1"), F.lit(False))
        return marked.where(may).select(*df.columns), marked.where(~may).select(*df.columns)

    return parts
