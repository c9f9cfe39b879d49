"""Arithmetic that can't overflow, retry delays, and bytes as text."""

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 2**64 - 1
WIDE = "decimal(38,0)"


def saturating_add(a: Column, b: Column) -> Column:
    """Sum of two unsigned 64-bit numbers, at most the largest one."""
    return F.least(a.cast(WIDE) + b.cast(WIDE), F.lit(str(MOST)).cast(WIDE)).cast("decimal(20,0)")


def saturating_mul(a: Column, b: Column) -> Column:
    """Product of two unsigned 64-bit numbers, at most the largest one; it is tested by division,
    since a product of two may have 39 digits."""
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    over = (b > 0) & (a > F.floor(F.lit(str(MOST)).cast("decimal(20,0)") / F.nullif(b, F.lit(0))))
    return F.when(F.coalesce(over, F.lit(False)), F.lit(str(MOST)).cast(WIDE)).otherwise((a * b).cast(WIDE)).cast("decimal(20,0)")


def backoff_ms(attempt: int, first_ms: float, most_ms: float, jitter: float = 0.0, draw=random.random) -> float:
    """Delay before retry ``attempt`` (from 1): doubled each time up to a limit, then varied by
    up to ``jitter`` of itself either way."""
    delay = min(first_ms * 2.0 ** min(attempt - 1, 60), most_ms)
    return max(0.0, delay * (1 + (2 * draw() - 1) * jitter))


def big_endian(data: Column, offset: int, length: int) -> Column:
    """An unsigned big-endian field of a binary column."""
    return F.conv(F.hex(F.substring(data, offset + 1, length)), 16, 10).cast("decimal(20,0)")
