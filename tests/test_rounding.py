"""Rounding by the exact binary value against Python's."""

import math
import random

import pytest

from annolake.functions.rounding import exact_round
from pyspark.sql import functions as F


def drawn(seed, count):
    rng = random.Random(seed)
    out = [0.0, -0.0, 2.675, 0.5, 1.5, 2.5, -2.5, 0.125, 0.375, 1e-7, -1e-7, 5e-7, 1.0000005, 0.1 + 0.2, 1e15, 4503599627370495.5, 4503599627370496.0, 9007199254740993.0, 1e22, 1.7976931348623157e308, 5e-324, math.inf, -math.inf]
    out += [k / 2**m for m in range(1, 12) for k in range(1, 200, 2)]  # ties for few digits
    out += [math.nextafter((2 * k + 1) / 2 / 10**d, math.inf * s) if s else (2 * k + 1) / 2 / 10**d for d in (1, 4, 6) for k in range(300) for s in (-1, 0, 1)]
    while len(out) < count:
        x = rng.choice([rng.random(), rng.uniform(-1000, 1000), rng.lognormvariate(0, 20), round(rng.random(), 5) + 5e-6, rng.randint(0, 10**6) / 64])
        out.append(x * rng.choice([1, -1]))
    return out


@pytest.mark.parametrize("digits", [0, 1, 4, 6, 12])
def test_against_python(spark, digits):
    values = drawn(digits, 200_000)
    found = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").repartition(4).select("k", "x", exact_round(F.col("x"), digits).alias("y")).toPandas()
    bad = [(x, y, round(x, digits)) for x, y in zip(found.x, found.y) if y != round(x, digits)] if digits else [(x, y, float(round(x))) for x, y in zip(found.x, found.y) if math.isfinite(x) and y != float(round(x))]
    assert not bad, bad[:5]


def test_odd_values(spark):
    row = spark.sql("select double('nan') n, cast(null as double) z, 0.5D h").select(*(exact_round(F.col(c), 0).alias(c) for c in "nzh")).first()
    assert math.isnan(row["n"]) and row["z"] is None and row["h"] == 0.0
    with pytest.raises(ValueError):
        exact_round(F.lit(1.0), 16)
