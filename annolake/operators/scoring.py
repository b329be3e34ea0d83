"""Precision, recall and F1 of predictions against gold annotations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-10


def counted(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str], group: list[str]) -> DataFrame:
    """group, by, annotated, predicted, tp. Predictions that are in the gold list are true; gold duplicates count. by: some of keys.

    Both sides are read once: they meet by keys, and what is left are counts by group and label, a few rows.
    """
    none = [F.lit(None).cast(predicted.schema[c].dataType).alias(c) for c in group]
    both = predicted.select(*keys, *group, F.lit(True).alias("_said")).unionByName(gold.select(*keys, *none, F.lit(False).alias("_said")))
    # One sort by keys; a tuple with a null is equal to none.
    met = both.withColumn("_held", F.max(~F.col("_said")).over(Window.partitionBy(*keys))).withColumn("_whole", reduce(and_, (F.col(c).isNotNull() for c in keys)))
    said, hit = F.col("_said"), F.col("_said") & F.col("_held") & F.col("_whole")
    counts = met.groupBy("_said", *group, *by).agg(F.count_if(~said).alias("annotated"), F.count_if(said).alias("predicted"), F.count_if(hit).alias("tp"))
    return gridded(counts, group, by)


def gridded(counts: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Counts (_said: of predictions; group: null of gold ones) as group, by, annotated, predicted, tp."""
    names = [*group, *by, "annotated", "predicted", "tp"]
    # Names of prediction sets by labels: both are few. Each set is told of all labels of the gold list.
    few = counts.agg(F.collect_list(F.struct("_said", *names)).alias("_rows"))
    sets = F.array_distinct(F.transform(F.filter("_rows", lambda x: x["_said"]), lambda x: F.struct(*[x[c].alias(c) for c in group]))) if group else F.array(F.struct(F.lit(True)))
    few = few.withColumn("_named", sets).withColumn("_gold", F.filter("_rows", lambda x: ~x["_said"]))
    grid = F.flatten(F.transform("_named", lambda g: F.transform("_gold", lambda x: F.struct(*[g[c].alias(c) for c in group], *[x[c].alias(c) for c in names if c not in group]))))
    told = F.transform(F.filter("_rows", lambda x: x["_said"]), lambda x: F.struct(*[x[c].alias(c) for c in names]))
    return few.select(F.inline(F.concat(grid, told))).groupBy(*group, *by).agg(*[F.sum(c).alias(c) for c in ("annotated", "predicted", "tp")])


def tuple_counts(gold: np.ndarray, predicted: list[np.ndarray], kind_of: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Distinct tuples counted by kind, as `counted` counts them: rows (set, -1: gold; kind, annotated, predicted, tp)."""
    gold, out = np.unique(gold), []
    for m, said in [(-1, gold), *enumerate(map(np.unique, predicted))]:
        kinds, which = np.unique(kind_of(said), return_inverse=True)
        n, hit = np.bincount(which, minlength=len(kinds)), np.bincount(which, np.isin(said, gold, assume_unique=True), len(kinds)).astype(np.int64)
        none = np.zeros_like(n)
        out.append(np.stack([np.full(len(kinds), m), kinds, *((n, none, none) if m < 0 else (none, n, hit))]))
    return out


def ratio(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + EPS)


def micro_macro(counts: DataFrame, group: list[str]) -> DataFrame:
    """Micro scores over all, macro scores as means over labels that the gold annotations have."""
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("annotated"))
    each = counts.withColumns({"_p": p, "_r": r, "_f": f1(p, r)})
    own = F.col("annotated") > 0
    sums = each.groupBy(*group).agg(
        *[F.avg(F.when(own, F.col(c))).alias(name) for c, name in (("_p", "precision"), ("_r", "recall"), ("_f", "f1"))],
        *[F.sum(c).alias(f"_{c}") for c in ("tp", "predicted", "annotated")],
    )
    mp, mr = ratio(F.col("_tp"), F.col("_predicted")), ratio(F.col("_tp"), F.col("_annotated"))
    return sums.select(*group, "precision", "recall", "f1", mp.alias("micro_precision"), mr.alias("micro_recall"), f1(mp, mr).alias("micro_f1"))


def set_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn and scores of distinct tuples; 0 where nothing can be divided."""
    a, b = gold.select(*keys).distinct().withColumn("_g", F.lit(1)), predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    sums = a.join(b, keys, "full").agg(F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    safe = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"))


def multiclass(pairs: DataFrame, true: str, found: str) -> DataFrame:
    """accuracy, f1_macro (over labels that occur), f1_micro."""
    confusion = pairs.groupBy(F.col(true).alias("t"), F.col(found).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("held"), F.lit(0).cast("long").alias("given")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("held"), F.col("n").alias("given")))).alias("x"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    each = sides.groupBy("x.label").agg(F.sum("x.held").alias("held"), F.sum("x.given").alias("given"), (F.sum("hit") / 2).alias("tp"))
    score = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("held") + F.col("given")), F.lit(0.0))
    accuracy = F.sum("tp") / F.sum("held")
    return each.agg(accuracy.alias("accuracy"), F.avg(score).alias("f1_macro"), accuracy.alias("f1_micro"))
