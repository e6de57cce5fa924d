"""Rounding of doubles by their exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products are exact (Dekker, 1971).
SPLIT = 134217729.0
#: Powers of ten up to here are exact doubles.
MOST_DIGITS = 15


def round_half_even(x: Column, digits: int) -> Column:
    """``x`` rounded to ``digits`` decimals, correctly by the exact decimal expansion of the double, halves to even.

    ``x`` times a power of ten is taken as a rounded product and its exact error. Only a product that is itself a tie needs the error: it says on
    which side of the tie the value is. Beyond 2^53 units of the last place a double is its own nearest decimal. Null, NaN and infinite values stay.
    """
    if not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"digits must be between 0 and {MOST_DIGITS}")
    scale = float(10**digits)
    high = scale * SPLIT - (scale * SPLIT - scale)
    low = scale - high

    def rounded(size: Column) -> Column:
        product = size * scale

        def settle(p: Column) -> Column:
            upper = size * SPLIT - (size * SPLIT - size)
            lower = size - upper
            error = ((upper * high - p) + upper * low + lower * high) + lower * low
            down = F.floor(p).cast("double")  # exact, as is its difference from p, which isn't negative
            even = F.when(F.pmod(down, F.lit(2.0)) == 0, down).otherwise(down + 1)
            tie = F.when(error > 0, down + 1).when(error < 0, down).otherwise(even)
            return F.when(p - down == 0.5, tie).otherwise(F.rint(p)) / scale

        return F.when(product < float(1 << 53), F.transform(F.array(product), settle)[0]).otherwise(size)

    # a negative value that rounds to zero keeps its sign
    value = x.cast("double")
    size = F.transform(F.array(F.abs(value)), rounded)[0]
    return F.when((value < 0) | (value.cast("string") == "-0.0"), -size).otherwise(size)
