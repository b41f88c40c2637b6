"""Sharding by a permutation-filled lookup table. DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash60(text: str, salt: str = "") -> int:
    """The first 15 hex digits of an MD5 as a number."""
    return int(hashlib.md5(f"{salt}{text}".encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int) -> list[int]:
    """Slot -> index of its shard. Each shard prefers the slots in the order offset, offset + skip, ... modulo the prime
    ``size``, a permutation of all slots; shards take turns claiming the first slot of their order that is still free.

    The work is ``size`` claims, fixed by the configuration and not by the data, so it is done where the plan is made.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named and distinct")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    start = [hash60(s, "offset:") % size for s in shards]
    skip = [hash60(s, "skip:") % (size - 1) + 1 for s in shards]
    table, step, claimed = [-1] * size, [0] * len(shards), 0
    while claimed < size:
        for s in range(len(shards)):
            slot = (start[s] + step[s] * skip[s]) % size
            while table[slot] >= 0:
                step[s] += 1
                slot = (start[s] + step[s] * skip[s]) % size
            table[slot] = s
            step[s] += 1
            claimed += 1
            if claimed == size:
                break
    return table


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard_id): one row per slot."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard_id"))


def assign_shards(docs: DataFrame, shards: list[str], size: int = 5003, key_col: str = "doc_id") -> DataFrame:
    """Every row with ``slot`` and ``shard_id`` added (columns of those names are replaced).

    A row's slot is a hash of its key modulo the table's size; a broadcast join with the table, whose size the
    configuration fixes, places it in constant time without a shuffle. Shards get even shares of keys, and
    when a shard goes, almost only its own keys move. The key should be distinct (an id): rows that repeat a key share its shard.
    A null key hashes like the empty string.
    """
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % F.lit(size)
    placed = docs.drop("shard_id").withColumn("slot", slot.cast("int"))
    return placed.join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "slot")
