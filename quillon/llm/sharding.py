"""Shard placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: (offset + k * skip) mod
size. Shards take turns claiming their next free slot until the table is full, so each holds
size / shards slots, one more or less, and adding or removing a shard moves few slots. The table is
broadcast (its size is the prime, fixed in advance); placing a row is one hash and one lookup.

Only DataFrame operations touch rows. The fill runs once on the driver over the table alone.

Defined cases: a null id is placed as the empty text; an empty table gives an empty table; repeated
ids go to one shard; other columns pass through untouched (``place`` refuses names it would add).
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: prime, and over a hundred times the shards of a usual run.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime no smaller than the number of shards")
    at = [zlib.crc32(f"offset:{s}".encode()) % size for s in shards]
    skip = [zlib.crc32(f"skip:{s}".encode()) % (size - 1) + 1 for s in shards] if size > 2 else [1] * len(shards)
    table, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            table[at[shard]] = shard
            left -= 1
            if not left:
                break
    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 32 bits of its md5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(size)).cast("int")


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard) as a DataFrame made of one literal."""
    text = ",".join(map(str, table))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with columns slot and shard."""
    if {"slot", "shard"} & set(df.columns):
        raise ValueError("the input has a column named slot or shard")
    table = table_frame(df.sparkSession, fill(shards, size))
    return df.withColumn("slot", slot(df[key], size)).join(F.broadcast(table), "slot", "left")


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, spread: int = 8, size: int = TABLE_SIZE) -> None:
    """Writes ``df`` as one folder a shard, each by ``spread`` tasks, so no shard is one task's work."""
    placed = place(df, key, shards, size)
    salt = F.pmod(F.xxhash64(F.col("slot"), F.monotonically_increasing_id()), F.lit(spread))
    placed.repartition(len(shards) * spread, "shard", salt).drop("slot").write.partitionBy("shard").parquet(path)
