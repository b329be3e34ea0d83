"""Column functions on arrays of logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def masked(logits: Column, allowed: Column) -> Column:
    """Logits with those that are not allowed at minus infinity."""
    return F.zip_with(logits, allowed, lambda x, a: F.when(a, x).otherwise(F.lit(float("-inf"))))


def adaptive_labels(logits: Column) -> Column:
    """Places of logits above the first, which is the threshold; the first if there are none."""
    places = F.filter(F.sequence(F.lit(1), F.size(logits) - 1), lambda k: F.element_at(logits, k + 1) > F.element_at(logits, 1))
    return F.when(F.size(places) > 0, places).otherwise(F.array(F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
