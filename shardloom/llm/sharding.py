"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size. Shards take turns and
each claims the first slot of its order that is still free, until none is. A row's slot is a hash of
its key modulo the size, so placement takes one lookup, shards are even to within a slot's share, and
few rows move when a shard comes or goes. The table is a parameter, not data: its size is fixed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.base import unused

SHARDS = 32
SLOTS = 4099


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (by its place in ``shards``) of each slot."""
    if not shards:
        raise ValueError("no shards")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, no less than that of shards")
    digests = [hashlib.md5(x.encode()).hexdigest() for x in shards]
    at = [int(x[:8], 16) % slots for x in digests]
    step = [int(x[8:16], 16) % (slots - 1) + 1 for x in digests]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 8 hex digits of its MD5, modulo the number of slots. Null counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key_col: str, shards: list[str] | int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds two columns to each row of ``df``: slot (int) and shard (string).

    Where ``df`` has a column of such a name, the new one's begins with an underscore, or several. Null
    key: placed like an empty text. Rows with equal keys are placed alike. Empty table: no rows.
    """
    slot, shard = unused(df, "slot", "shard")
    names = [f"shard-{k:04d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    table = ",".join(map(str, fill(names, slots)))
    lookup = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias(slot, "k"))
    lookup = lookup.select(slot, F.element_at(F.array(*map(F.lit, names)), F.col("k").cast("int") + 1).alias(shard))
    return df.withColumn(slot, slot_of(F.col(f"`{key_col}`"), slots)).join(F.broadcast(lookup), slot).select(*[F.col(f"`{c}`") for c in df.columns], slot, shard)
