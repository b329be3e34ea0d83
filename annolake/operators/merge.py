"""Two-stage predictions: spans of a term extractor with labels of a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.operators.spans import SPAN, last_wins

#: Other names of the modes for terms without a label.
MODES = {"error": "strict", "raise": "strict", "raise_error": "strict", "strict": "strict", "drop": "ignore", "skip": "ignore", "ignore": "ignore"}


def missing(terms: DataFrame, classes: DataFrame) -> DataFrame:
    """Terms that have no row in classes."""
    return terms.join(classes.select(*SPAN).distinct(), SPAN, "left_anti")


def merged(terms: DataFrame, classes: DataFrame, mode: str = "ignore", include_na: bool = False) -> DataFrame:
    """SPAN, label, confscore; of several labels of a span the last counts. strict: a term without one is an error of the job."""
    from annolake.operators import rejects

    known = rejects.labelled(terms.select(*SPAN), last_wins(classes, SPAN, ["ord"]))
    made = rejects.routed(known, "merged", "strict" if MODES[mode.lower()] == "strict" else "drop")[0]
    return made if include_na else made.filter("label <> 'NA'")


def all_pairs(terms: DataFrame, classes: DataFrame) -> DataFrame:
    """Every extractor m with every classifier m: their spans that agree."""
    known = last_wins(classes, ["m", *SPAN], ["ord"]).select(F.col("m").alias("classifier"), *SPAN, "label")
    return terms.select(F.col("m").alias("extractor"), *SPAN, F.col("label").alias("term_label")).join(known, SPAN)


def labelled_or_na(entities: DataFrame) -> DataFrame:
    """label from predicted_label; those without get NA and the score -1."""
    none = F.col("predicted_label").isNull()
    return entities.withColumns({"label": F.coalesce("predicted_label", F.lit("NA")), "confscore": F.when(none, F.lit(-1.0)).otherwise(F.col("confscore"))})
