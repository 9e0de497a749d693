"""Blocked Bloom filter as a scalar subquery: an array of 64-bit blocks, each key setting three bits of one block.

The filter takes two bytes a key, so it is sent to every task at any size that a list of keys has. It may be
tested in filters and projections, where generated code evaluates it; it gives no false negatives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
_SHIFTS = (46, 52, 58)


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(h, F.lit(n_blocks))


def _mask(h: Column) -> Column:
    mask = F.lit(0).cast("bigint")
    for s in _SHIFTS:
        bit = F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def may_contain(keys: DataFrame, column: str, bits_per_key: int = BITS_PER_KEY) -> Callable[[Column], Column]:
    """A test for membership in the distinct values of a column of a written table; true for every member."""
    n_blocks = max(1, -(-keys.count() * bits_per_key // 64))
    h = F.xxhash64(column)
    masks = keys.filter(F.col(column).isNotNull()).groupBy(_block(h, n_blocks).alias("b")).agg(F.bit_or(_mask(h)).alias("m"))
    every = keys.sparkSession.range(n_blocks).join(masks, F.col("id") == F.col("b"), "left")
    blocks = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("m", F.lit(0)).alias("m")))).alias("x"))
    blocks = blocks.select(F.transform("x", lambda x: x.m)).scalar()
    return lambda key: F.element_at(blocks, _block(F.xxhash64(key), n_blocks).cast("int") + 1).bitwiseAND(_mask(F.xxhash64(key))) == _mask(F.xxhash64(key))
