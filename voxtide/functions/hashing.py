"""Reproducible pseudo-random numbers derived from row keys.

They depend only on the key and the seed, never on partitioning or on task
attempts, and any engine with md5 computes the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def hash_int(key: Column, seed: object) -> Column:
    """Integer in [0, 2^32) from the key and the seed."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_pick(key: Column, seed: object, n: int) -> Column:
    """Integer in [0, n)."""
    return F.pmod(hash_int(key, seed), F.lit(n)).cast("int")
