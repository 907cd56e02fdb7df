"""Sizes: blocks, slots, limits.  All on the driver, but slots, which is also a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEYS = 1 << 40
MIN_KEY, MAX_KEY = 16, 65535
MAX_PAYLOAD, MAX_FINGERPRINT = 8, 4
DEFAULT_SEED = 0x1234567890ABCDEF
BIJECTION_LAMBDA, BIJECTION_BUCKETS = 3.0, 1024
SPLIT_AT = 8
DIRECT_SEEDS, SPLIT_SEEDS = 1 << 21, 1 << 20
PILOT_LAMBDA, PILOT_BUCKETS, PILOTS, LOAD = 3.16, 10000, 256, 0.99
OVERFLOW_SIGMAS = 7.0


def _blocks(keys: int, per_bucket: float, buckets: int) -> int:
    total = max(1, math.ceil(keys / per_bucket))
    return max(2, -(-total // buckets))


def bijection_blocks(keys: int) -> int:
    return _blocks(keys, BIJECTION_LAMBDA, BIJECTION_BUCKETS)


def pilot_blocks(keys: int) -> int:
    return _blocks(keys, PILOT_LAMBDA, PILOT_BUCKETS)


def slots(keys: int) -> int:
    return max(math.ceil(keys / LOAD), keys)


def slots_column(keys: Column) -> Column:
    return F.greatest(F.ceil(keys.cast("double") / F.lit(LOAD)).cast("long"), keys.cast("long"))


def block_limit(keys: int, blocks: int) -> int:
    """The most keys that a block of evenly spread keys holds, but for one chance in about 10^12."""
    mean = keys / blocks
    return math.ceil(mean + OVERFLOW_SIGMAS * math.sqrt(mean))


def ram_bits(blocks: int) -> int:
    return math.ceil(math.log2(blocks)) if blocks > 1 else 0
