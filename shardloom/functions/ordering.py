"""Reproducible order and draws from hashes.

A key's place depends on the seed and the key alone, so an order is the same however the data is
partitioned, and other engines can compute it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, *parts: Column | str) -> Column:
    """Sort key of a seeded shuffle: the MD5 of seed and parts, joined by ``|``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def draw(key: Column) -> Column:
    """A whole number from 0 to 2^32 - 1, of the first 8 hex digits of an order key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def uniform_int(key: Column, most: Column) -> Column:
    """A whole number from 0 to ``most``, both included."""
    return F.pmod(draw(key), most + 1)


def local_draw(seed: int, *parts: object) -> float:
    """What ``draw`` gives, from 0 up to 1, on the driver."""
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 4294967296.0
