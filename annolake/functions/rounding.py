"""Rounding by the exact binary value of a double, ties to even: what `round(x, digits)` of Python gives.

Spark's own round and bround go through the shortest decimal text of a double, so 2.675 counts as
a tie though its value lies below. Here x * 10^digits is taken exactly, as a product and its
rounding error (both halves of each factor multiplied apart), and compared with the tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^27 + 1 parts a double of 53 bits into two halves.
SPLITTER = 134_217_729.0
#: From here on the doubles next to x are further apart than decimal places, so x is its own rounding.
WHOLE = float(2**53)


def halves(x: Column) -> tuple[Column, Column]:
    high = x * SPLITTER - (x * SPLITTER - x)
    return high, x - high


def exact_round(x: Column, digits: int) -> Column:
    """x, a double, to 0 to 15 digits after the point; NaN, infinities and nulls stay."""
    if not 0 <= digits <= 15:
        raise ValueError(f"digits must be 0 to 15, not {digits}")
    x, scale = x.cast("double"), float(10**digits)
    size = F.abs(x)
    product = size * F.lit(scale)
    (a, b), high = halves(size), scale * SPLITTER - (scale * SPLITTER - scale)
    c, d = F.lit(high), F.lit(scale - high)
    error = ((a * c - product) + a * d + b * c) + b * d
    low = F.floor(product).cast("double")
    over = product - low - F.lit(0.5)
    # What is over the tie has the sign of `over`, or, where that is 0, of the product's error.
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    # A product that is whole may stand for half a place more or less, where doubles have no halves: to even as well.
    odd = F.when((over == -0.5) & (F.abs(error) == 0.5) & (low % 2 == 1), F.signum(error)).otherwise(0.0)
    near = (low + F.when(up, 1.0).otherwise(odd)) / F.lit(scale)
    made = F.when(F.isnan(x) | (product >= WHOLE), size).otherwise(near)
    return F.when(x == 0, x).when(x < 0, -made).otherwise(made)
