"""Ensembles of entity and relation predictions by votes, for one or many sets of models at once.

votes: a row each model m and item (an entity's span, a relation's pair), with a weight. A
field's value wins by summed weight, then count, then its text; an item is kept if the
winner of the deciding field (label, or predicate) has a score that reaches the threshold.
`group` columns (a combination of models, say) keep several ensembles apart in one job.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.operators.spans import SPAN, first_wins

#: Other names of the methods.
METHODS = {"majority_voting": "majority", "weighted_voting": "weighted", "intersect": "intersection"}


def method_of(name: str) -> str:
    name = name.lower().replace("-", "_")
    name = METHODS.get(name, name)
    if name not in ("majority", "weighted", "intersection", "union"):
        raise ValueError(f"unknown ensemble method: {name}")
    return name


def checked_weights(weights: list[float] | None, models: int) -> list[float]:
    weights = weights or [1.0] * models
    if len(weights) != models or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("one weight for each model is needed, none negative, not all zero")
    return weights


def threshold(method: str, weights: list[float], explicit: float | None = None) -> float:
    if explicit is not None and method != "union":
        return explicit
    return {"intersection": float(len(weights)), "union": 1.0, "weighted": sum(weights) / 2 + 1e-12, "majority": float(len(weights) // 2 + 1)}[method]


def votes(predictions: DataFrame, keys: list[str], order: str = "ord", *group: str) -> DataFrame:
    """Each model's first item for each key."""
    return first_wins(predictions, [*group, "m", *keys], [order])


def weighted(predictions: DataFrame, spark: SparkSession, weights: list[float]) -> DataFrame:
    known = spark.createDataFrame(list(enumerate(weights)), "m int, weight double")
    return predictions.join(F.broadcast(known), "m")


def field_vote(cast: DataFrame, keys: list[str], field: str) -> DataFrame:
    """keys, field, weight sum and number of models of the winning value; nulls don't vote."""
    sums = cast.filter(F.col(field).isNotNull()).groupBy(*keys, field).agg(F.sum("weight").alias("_weight"), F.count(F.lit(1)).alias("_count"), F.count_distinct("m").alias("_models"))
    best = first_wins(sums, keys, [F.desc("_weight"), F.desc("_count"), F.col(field).cast("string")])
    return best.select(*keys, field, F.col("_weight").alias(f"{field}_weight"), F.col("_models").alias(f"{field}_models"))


def ensembled(cast: DataFrame, keys: list[str], decider: str, others: list[str], method: str, weights: list[float], explicit: float | None = None, mean_of_winner: bool = False) -> DataFrame:
    """Kept items with their winning fields and mean confscore.

    mean_of_winner: only votes for the winning decider count in the mean, as for relations.
    """
    method = method_of(method)
    # All fields are voted for at once, so votes are read once; a null field loses to any other, and still counts in the mean of all.
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("_field"), F.col(c).cast("string").alias("_value")) for c in (decider, *others)]))
    scored = [F.sum("confscore").alias("_sum"), F.count("confscore").alias("_scores")]
    sums = cast.select(*keys, "m", "weight", "confscore", each).groupBy(*keys, "_field", "_value").agg(F.sum("weight").alias("_weight"), F.count(F.lit(1)).alias("_count"), F.count_distinct("m").alias("_models"), *scored)
    rank = F.struct(F.col("_value").isNull().alias("none"), (-F.col("_weight")).alias("w"), (-F.col("_count")).alias("n"), F.col("_value").alias("value"), F.col("_models").alias("models"), F.col("_sum").alias("sum"), F.col("_scores").alias("scores"))
    best = sums.groupBy(*keys, "_field").agg(F.min(rank).alias("_x"), F.sum("_sum").alias("_sum"), F.sum("_scores").alias("_scores"))
    of = lambda field, value: F.max(F.when(F.col("_field") == field, value))
    mean = F.try_divide("_x.sum", "_x.scores") if mean_of_winner else F.try_divide("_sum", "_scores")
    score = -F.col("_x.w") if method == "weighted" else F.col("_x.models").cast("double")
    made = best.groupBy(*keys).agg(of(decider, F.col("_x.value")).cast(cast.schema[decider].dataType).alias(decider), of(decider, score).alias("score"), of(decider, mean).alias("confscore"), *[of(c, F.col("_x.value")).cast(cast.schema[c].dataType).alias(c) for c in others])
    kept = made.filter(F.col(decider).isNotNull())
    return kept if method == "union" else kept.filter(F.col("score") >= threshold(method, weights, explicit))


def entity_ensemble(predictions: DataFrame, spark: SparkSession, method: str, weights: list[float], explicit: float | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    weights = checked_weights(weights, len(weights))
    return ensembled(votes(weighted(predictions, spark, weights), SPAN), SPAN, "label", list(others), method, weights, explicit)


PAIR = ["paper_id", "location", "subject_start_idx", "subject_end_idx", "object_start_idx", "object_end_idx"]


def relation_ensemble(predictions: DataFrame, spark: SparkSession, method: str, weights: list[float], explicit: float | None = None) -> DataFrame:
    """A model's first predicate of a pair votes; for unions each predicate is an item of its own."""
    weights = checked_weights(weights, len(weights))
    keys = [*PAIR, "kind"] if method_of(method) == "union" else PAIR
    cast = votes(weighted(predictions, spark, weights).withColumn("kind", F.col("predicate")), keys, "predicate")
    return ensembled(cast, keys, "predicate", ["subject_label", "object_label"], method, weights, explicit, mean_of_winner=True).drop("kind")


def aligned_votes(values: np.ndarray, scores: np.ndarray, method: str, weights: list[float], explicit: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `relation_ensemble`, of votes that lie side by side: (items, in order, their values, scores and mean confscores).

    values: a row a model, a column an item; numbers in the order of what they stand for, -1: no vote. So nothing is grouped or sorted.
    """
    method, weights = method_of(method), checked_weights(weights, len(values))
    said = values >= 0
    same = (values[:, None] == values[None]) & said[:, None] & said[None]
    weight = np.einsum("jkn,k->jn", same, np.array(weights, float))
    models, mean = same.sum(1), np.einsum("jkn,kn->jn", same, np.where(said, scores, 0.0))
    if method == "union":
        first = said & ~np.array([(same[j, :j]).any(0) for j in range(len(values))])
        item, which = np.nonzero(first.T)
    else:
        best = np.lexsort((values, -models, -weight, ~said), axis=0)[0]
        item = np.flatnonzero(said.any(0))
        which = best[item]
    score = weight[which, item] if method == "weighted" else models[which, item].astype(float)
    kept = np.ones(len(item), bool) if method == "union" else score >= threshold(method, weights, explicit)
    item, which = item[kept], which[kept]
    return item, values[which, item], score[kept], mean[which, item] / models[which, item]


#: Where a relation stands: places if it has all of them, else texts and labels.
PLACES = ["subject_start_idx", "subject_end_idx", "subject_location", "object_start_idx", "object_end_idx", "object_location"]
TEXTS = ["subject_text_span", "subject_label", "object_text_span", "object_label"]
FIELDS = ["subject_text_span", "subject_label", "subject_uri", "object_text_span", "object_label", "object_uri"]


def has_all(*columns: str) -> Column:
    """Whether every one of the columns is there."""
    return F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x)


def relation_key(relations: DataFrame) -> DataFrame:
    """relations with pair: struct(by, and the fields of PLACES or of TEXTS; those that don't count are null)."""
    whole = has_all(*PLACES)
    own = [F.when(whole, F.col(c)).alias(c) for c in PLACES] + [F.when(~whole, F.col(c)).alias(c) for c in TEXTS]
    return relations.withColumn("pair", F.struct(F.when(whole, "places").otherwise("texts").alias("by"), *own))


def placed_votes(keyed: DataFrame) -> DataFrame:
    """Votes by texts with the pair of places that has the same texts in the paper, where there is just one; with none, or several, they stay as they are.

    Several pairs of places with one text are told apart by nothing that such a vote carries, so it is given to none of them.
    """
    # In one pass: all votes of one text lie together, and the places among them are told by a window. A null text meets nothing.
    same = Window.partitionBy("paper_id", *TEXTS)
    place = F.when(F.col("pair.by") == "places", F.col("pair"))
    sole = keyed.withColumns({"_low": F.min(place).over(same), "_high": F.max(place).over(same)})
    given = (F.col("pair.by") == "texts") & has_all("paper_id", *TEXTS) & (F.col("_low") == F.col("_high"))
    return sole.withColumn("pair", F.when(given, F.col("_low")).otherwise(F.col("pair"))).drop("_low", "_high")


def mixed_relation_ensemble(predictions: DataFrame, spark: SparkSession, method: str, weights: list[float], explicit: float | None = None, link: bool = False, order: str = "ord") -> DataFrame:
    """Relation ensemble of votes of which some carry no places: paper_id, places, texts, labels and uris (null: unknown), predicate, score, confscore.

    predictions: m, paper_id, PLACES, FIELDS, predicate, confscore and the place in the model's list. Votes with all places
    meet by these, the others by texts and labels; link: see `placed_votes`. Every field of the result is voted for.
    """
    weights = checked_weights(weights, len(weights))
    keyed = relation_key(predictions)
    keyed = placed_votes(keyed) if link else keyed
    keys = ["paper_id", "pair", *(["kind"] if method_of(method) == "union" else [])]
    cast = votes(weighted(keyed, spark, weights).withColumn("kind", F.col("predicate")), keys, order)
    # All fields are voted for at once: a model has one vote an item, so a count of votes is one of models.
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("predicate", *FIELDS)])
    sums = cast.select(*keys, "weight", "confscore", F.inline(each)).filter("value is not null").groupBy(*keys, "field", "value").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("models"), F.avg("confscore").alias("confscore"))
    best = sums.groupBy(*keys, "field").agg(F.min(F.struct((-F.col("weight")).alias("w"), (-F.col("models")).alias("n"), "value", "confscore")).alias("x"))
    of = lambda field, value: F.max(F.when(F.col("field") == field, value))
    score = -F.col("x.w") if method_of(method) == "weighted" else (-F.col("x.n")).cast("double")
    made = best.groupBy(*keys).agg(*(of(c, F.col("x.value")).alias(c) for c in ("predicate", *FIELDS)), of("predicate", score).alias("score"), of("predicate", F.col("x.confscore")).alias("confscore"))
    if method_of(method) != "union":
        made = made.filter(F.col("score") >= threshold(method_of(method), weights, explicit))
    fields = [F.coalesce(F.col("pair")[c], F.col(c)).alias(c) if c in TEXTS else F.col(c) for c in FIELDS]
    return made.select("paper_id", *(F.col("pair")[c].alias(c) for c in PLACES), *fields, "predicate", "score", F.round("confscore", 6).alias("confscore"))


def mixed_votes(model: np.ndarray, place: np.ndarray, text: np.ndarray, bare: np.ndarray, value: np.ndarray, score: np.ndarray, places: int, least: int) -> tuple[np.ndarray, ...]:
    """As `mixed_relation_ensemble` with link and a vote for each model: (items, their values, models and mean scores), of `least` models or more.

    Votes in the order of the models' lists; numbers from 0: place tells the places of a pair, text its paper, texts and labels, value what is
    voted for, in order; bare: the vote carries no places. An item is a place or, from `places` on, places + text.
    """
    low, high = np.full(text.max(initial=-1) + 1, places), np.full(text.max(initial=-1) + 1, -1)
    np.minimum.at(low, text[~bare], place[~bare])
    np.maximum.at(high, text[~bare], place[~bare])
    item = np.where(~bare, place, np.where(low == high, low, places + np.arange(len(low)))[text])
    models, values = model.max(initial=0) + 1, value.max(initial=0) + 1
    first = np.unique(item * models + model, return_index=True)[1]  # a model's first vote for an item
    said, which = np.unique(item[first] * values + value[first], return_inverse=True)
    count, total = np.bincount(which, minlength=len(said)), np.bincount(which, score[first], len(said))
    order = np.lexsort((said, -count, said // values))
    order = order[np.diff(said[order] // values, prepend=-1) != 0]
    order = order[count[order] >= least]
    return said[order] // values, said[order] % values, count[order], total[order] / count[order]


def listed_relations(relations: DataFrame) -> DataFrame:
    """relations: each paper's list, sorted by where the subject and the object are, then predicate and texts; what is missing comes as "" or -1."""
    order = ["subject_location", "subject_start_idx", "object_location", "object_start_idx", "predicate", "subject_text_span", "object_text_span"]
    key = F.struct(*(F.coalesce(F.col(c), F.lit(-1 if c.endswith("idx") else "")).alias(c) for c in order))
    rows = F.array_sort(F.collect_list(F.struct(key.alias("key"), F.struct(*(c for c in relations.columns if c != "paper_id")).alias("x"))))
    return relations.groupBy("paper_id").agg(F.transform(rows, lambda r: r["x"]).alias("relations"))


def sweep(predictions: DataFrame, spark: SparkSession, models: int, least: int, most: int, methods: list[str]) -> DataFrame:
    """Majority, intersection and union ensembles of all model combinations in one job: combo, method, the kept spans."""
    chosen = [c for k in range(least, most + 1) for c in combinations(range(models), k)]
    combos = spark.createDataFrame([("+".join(map(str, c)), m, len(c)) for c in chosen for m in c], "combo string, m int, size int")
    cast = votes(predictions, SPAN).withColumn("weight", F.lit(1.0)).join(F.broadcast(combos), "m")
    won = field_vote(cast, ["combo", "size", *SPAN], "label")
    rule = F.create_map(*[x for m in methods for x in (F.lit(m), {"majority": F.floor(F.col("size") / 2) + 1, "intersection": F.col("size").cast("long"), "union": F.lit(1).cast("long")}[m])])
    return won.select("*", F.explode(rule).alias("method", "least")).filter("label_models >= least").select("combo", "method", *SPAN, "label", "label_models")


def template(first_papers: DataFrame, kept: DataFrame) -> DataFrame:
    """paper_id, n_kept, has_metadata: the first model's papers, and others only if something of them is kept."""
    counts = kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_kept"))
    both = first_papers.select("paper_id", F.lit(True).alias("has_metadata")).join(counts, "paper_id", "full")
    return both.select("paper_id", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("has_metadata", F.lit(False)).alias("has_metadata"))


def listed(entities: DataFrame) -> DataFrame:
    """entities: each paper's list, sorted by location, start, end and label."""
    return entities.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("location", "start_idx", "end_idx", "label"))).alias("entities"))


def rank(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
