"""Partition assignment of PARTITION BY HASH, KEY, RANGE and LIST."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_partition(value: Column, n: int) -> Column:
    """HASH(value) into n partitions; null counts as 0."""
    return F.coalesce(F.pmod(value.cast("bigint"), F.lit(n)).cast("int"), F.lit(0))


def linear_hash_partition(value: Column, n: int) -> Column:
    """LINEAR HASH: masks of the next power of two, halved where they reach too far."""
    size = 1 << max(0, (n - 1).bit_length())
    at = value.cast("bigint").bitwiseAND(F.lit(size - 1))
    return F.when(at >= n, at.bitwiseAND(F.lit(size // 2 - 1))).otherwise(at).cast("int")


def range_partition(value: Column, bounds: list) -> Column:
    """RANGE: the first partition whose VALUES LESS THAN bound is above the value (null is in
    the first); a bound of None is MAXVALUE; null where no partition takes the value."""
    out = F.when(value.isNull(), F.lit(0))
    for i, b in enumerate(bounds):
        out = out.when(F.lit(True) if b is None else value < F.lit(b), F.lit(i))
    return out


def list_partition(value: Column, lists: list[list]) -> Column:
    """LIST: the partition that lists the value; null where none does."""
    out = None
    for i, values in enumerate(lists):
        known = [v for v in values if v is not None]
        test = value.isin(known) if known else F.lit(False)
        if None in values:
            test = test | value.isNull()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out
