"""Entity pairs: enumeration within and across sections, gates, negatives, post-processing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.schema import LABELS, PREDICATES

SIDES = ("subject", "object")


def sides(entities: DataFrame, *extra: str, by: tuple[str, ...] = ("paper_id", "location")) -> tuple[DataFrame, DataFrame]:
    """The entities as subjects and as objects, to be joined on paper_id and location."""
    names = ["start_idx", "end_idx", "label", "ord", *extra]
    return tuple(entities.select(*by, *(F.col(c).alias(f"{side}_{c}") for c in names)) for side in SIDES)


def forward_pairs(entities: DataFrame, *extra: str) -> DataFrame:
    """Pairs of one section, the subject before the object in the list, with `extra` columns of both."""
    subjects, objects = sides(entities, *extra)
    return subjects.join(objects, ["paper_id", "location"]).filter("subject_ord < object_ord")


def ordered_pairs(entities: DataFrame, *extra: str) -> DataFrame:
    """All pairs of different entities of one section, both ways, with `extra` columns of both."""
    subjects, objects = sides(entities, *extra)
    return subjects.join(objects, ["paper_id", "location"]).filter("subject_ord <> object_ord")


def cross_pairs(entities: DataFrame) -> DataFrame:
    """Forward pairs of a whole paper, with offsets in title + ' ' + abstract (see spans.shifted)."""
    subjects, objects = sides(entities.withColumn("section", F.col("location")).drop("location").withColumn("location", F.lit("all")), "section")
    return subjects.join(objects, ["paper_id", "location"]).filter("subject_ord < object_ord").drop("location")


def gated(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """Pairs whose labels can be related, with the predicates allowed. valid: a small fixed table."""
    rule = F.broadcast(valid.select(F.col("head").alias("subject_label"), F.col("tail").alias("object_label"), "predicates"))
    return pairs.join(rule, ["subject_label", "object_label"])


def valid_pairs(entities: DataFrame, valid: DataFrame, *extra: str, both_ways: bool = False, by: tuple[str, ...] = ("paper_id", "location")) -> DataFrame:
    """As `gated` over forward pairs (or, both_ways, over all ordered pairs) of one group, without making those that the labels bar.

    Each subject gets the labels that its object can have, a few, and meets only the entities of its group that have them.
    """
    subjects, objects = sides(entities, *extra, by=by)
    rule = F.broadcast(valid.select(F.col("head").alias("subject_label"), F.col("tail").alias("object_label"), "predicates"))
    made = subjects.join(rule, "subject_label").join(objects, [*by, "object_label"])
    return made.filter("subject_ord <> object_ord" if both_ways else "subject_ord < object_ord")


def apart(pairs: DataFrame) -> DataFrame:
    """Pairs of spans that don't overlap; touching spans are apart."""
    return pairs.filter("subject_end_idx + 1 <= object_start_idx or object_end_idx + 1 <= subject_start_idx")


def with_predicate(pairs: DataFrame, relations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The annotated predicate of each pair (of several, the last), else NA."""
    from annolake.operators.spans import last_wins

    known = last_wins(relations, keys, [order]).select(*keys, "predicate")
    return pairs.join(known, keys, "left").withColumn("predicate", F.coalesce("predicate", F.lit("NA")))


def negatives(pairs: DataFrame, relations: DataFrame, multiplier: int, order: Column, keys: list[str] | None = None) -> DataFrame:
    """Pairs without an annotation with the same starts, `multiplier` times as many as a paper's positives, in a given order."""
    keys = keys or ["paper_id", "location", "subject_start_idx", "object_start_idx"]
    free = pairs.join(relations.select(*keys).distinct(), keys, "left_anti")
    room = relations.groupBy("paper_id").agg((F.count(F.lit(1)) * multiplier).alias("_room"))
    ranked = free.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id").orderBy(order, *keys)))
    return ranked.join(room, "paper_id").filter("_n <= _room").drop("_n", "_room")


def negative_places(paper: np.ndarray, order: np.ndarray, annotated: np.ndarray, multiplier: int = 1) -> np.ndarray:
    """As `negatives`, of pairs that lie paper by paper: the places of the chosen ones, ties to the first. paper and order: numbers from 0, order below 2^24."""
    room = np.bincount(paper[annotated], minlength=paper.max(initial=-1) + 1) * multiplier
    free = np.flatnonzero(~annotated)
    free = free[np.argsort(paper[free].astype(np.int64) << 24 | order[free], kind="stable")]
    own = paper[free]
    begins = np.searchsorted(own, np.arange(len(room)))
    return free[np.arange(len(free)) - begins[own] < room[own]]


def completed(relations: DataFrame, entities: DataFrame, mode: str = "drop") -> DataFrame:
    """Relations with uri and text of both ends; the first entity of a span counts. Unmatched relations go, or (strict) are an error; see `rejects.completed` to keep them."""
    from annolake.operators import rejects

    return rejects.routed(rejects.completed(relations, entities, SIDES), "completed", mode)[0]


def is_legal() -> Column:
    """Whether labels and predicate are all of the scheme; a null one is not."""
    return F.coalesce(F.col("subject_label").isin(LABELS) & F.col("object_label").isin(LABELS) & F.col("predicate").isin(PREDICATES), F.lit(False))


def legal(relations: DataFrame) -> DataFrame:
    """Relations, of mentions or concepts, whose labels and predicate are all of the scheme; a null one is not."""
    return relations.filter(is_legal())


def mention_level(relations: DataFrame) -> DataFrame:
    return relations.select("paper_id", "subject_text_span", "subject_label", "predicate", "object_text_span", "object_label").distinct()


def concept_level(relations: DataFrame) -> DataFrame:
    return relations.select("paper_id", "subject_uri", "subject_label", "predicate", "object_uri", "object_label").distinct()
