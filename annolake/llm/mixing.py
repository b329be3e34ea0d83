"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets the weight p^a / sum p^a. The exponent a is
found by bisection: the largest that meets a target entropy (as a share of the largest
possible), or the smallest that keeps repetition within a limit. Weights become budgets:
`budget` tokens in all, or as many as the source that is weighted least against its share
needs for one epoch (no document is then left out).

A budget is realised in epochs over blocks. A source's documents fall into `blocks` blocks
by a hash, so a source of any size has few; each epoch visits the blocks in an order of its
own, and the documents of a block in the order of their places. Whole epochs take all; the last takes blocks in its order
while they fit, then documents of the next block in their order while they fit.

Edge cases: null and empty texts have no tokens and belong to any epoch that reaches their
place; a null source is a source of its own; a source without tokens keeps one epoch;
repeated rows are rows of their own; an empty table gives an empty result; `columns` names
the input columns that the result keeps, beside its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.llm.common import stored


def weights(tokens: list[float], exponent: float) -> list[float]:
    """Normalised weights; sources without tokens get none."""
    total = sum(tokens)
    powers = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [p / sum(powers) for p in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x)


def bisected(holds, low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The point where `holds`, true at `high` only from there on, becomes true."""
    if holds(low):
        return low
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def repetition(tokens: list[float], w: list[float], budget: float | None) -> float:
    """How often the most repeated source is read."""
    rates = [x / t for x, t in zip(w, tokens) if t]
    return max(rates) * (budget or 1 / min(rates))


def exponent(tokens: list[float], entropy_share: float | None = None, repetition_limit: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1] for a target entropy, or the smallest for a repetition limit."""
    some = [t for t in tokens if t]
    if len(some) < 2:
        return 1.0
    if entropy_share is not None:
        target = entropy_share * math.log(len(some))
        return bisected(lambda a: entropy(weights(some, a)) <= target)
    return bisected(lambda a: repetition(some, weights(some, a), budget) <= repetition_limit * (1 + 1e-12))


def tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, columns: list[str], entropy_share: float | None = None, repetition_limit: float | None = None, budget: int | None = None, blocks: int = 1024, seed: int = 17) -> DataFrame:
    """A row for each visit of a document: columns, source, n_tokens, weight, epoch, block_order, place.

    Reading an epoch by (block_order, place) is its permutation. The text is read twice;
    what is joined to it is one row a source.
    """
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks))
    place = F.xxhash64(F.lit(seed + 2), "doc_id")
    block_order = lambda epoch: F.xxhash64(F.lit(seed + 1), epoch, block)
    own = docs.select("source", block.alias("block"), tokens().alias("n"))
    totals = stored(own.groupBy("source", "block").agg(F.sum("n").alias("held")), "blocks")
    found = [(r["source"], r["held"]) for r in totals.groupBy("source").agg(F.sum("held").alias("held")).orderBy("source").collect()]  # a row a source
    held = [float(t) for _, t in found]
    w = weights(held, exponent(held, entropy_share, repetition_limit, budget)) if sum(held) else held
    total = budget or (1 / min(x / t for x, t in zip(w, held) if t) if sum(held) else 0)
    plan = [(s, x, *(divmod(int(x * total + 0.5), int(t)) if t else (1, 0))) for (s, _), x, t in zip(found, w, held)]
    rule = spark.createDataFrame(plan, "rule_source string, weight double, whole int, rest long")

    # Where the last epoch ends: the order of the block in which it does, and the place there.
    at = F.xxhash64(F.lit(seed + 1), "whole", "block").alias("at")
    partial = totals.join(F.broadcast(rule), F.col("source").eqNullSafe(F.col("rule_source"))).filter("rest > 0").select("rule_source", "block", "held", "rest", at)
    upto = F.sum("held").over(Window.partitionBy("rule_source").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, 0))
    ends = partial.withColumn("upto", upto).filter("upto > rest").groupBy("rule_source").agg(F.min(F.struct("at", "block", (F.col("rest") - F.col("upto") + F.col("held")).alias("room"))).alias("end"))
    ends = stored(ends.select(F.col("rule_source").alias("end_source"), "end.*"), "ends")
    edge = docs.select("source", "text", block.alias("own"), place.alias("place")).join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("end_source")) & (F.col("own") == F.col("block")))
    inside = F.sum("n").over(Window.partitionBy("end_source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    limits = edge.select("end_source", "place", "room", tokens().alias("n")).withColumn("upto", inside).filter("upto <= room").groupBy(F.col("end_source").alias("limit_source")).agg(F.max("place").alias("limit"))
    rule = rule.join(F.broadcast(ends), F.col("rule_source").eqNullSafe(F.col("end_source")), "left").join(F.broadcast(limits), F.col("rule_source").eqNullSafe(F.col("limit_source")), "left")
    rule = stored(rule.select("rule_source", "weight", "whole", F.col("at").alias("end_at"), F.col("block").alias("end_block"), "limit"), "rule")

    kept = [F.col(c) for c in columns if c != "source"]
    last = block_order(F.col("whole"))
    more = (last < F.col("end_at")) | ((block == F.col("end_block")) & (place <= F.col("limit")))
    rows = docs.join(F.broadcast(rule), F.col("source").eqNullSafe(F.col("rule_source"))).withColumn("n_tokens", tokens())
    visits = F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.when(visits > 0, F.sequence(F.lit(0), visits - 1))))
    return rows.select(*kept, "source", "n_tokens", "weight", "epoch", block_order(F.col("epoch")).alias("block_order"), place.alias("place"))
