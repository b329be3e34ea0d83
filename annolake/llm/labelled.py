"""A bounded sample of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import fold, stored

#: At most so many labelled rows fit a classifier.
SAMPLE_ROWS = 8_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: int = 0, folds: int = 5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label: `rows` labelled rows at most, none of the held-out fold, in the order of a hash.

    Rows without a label or an id are left out; one label per doc_id, the largest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    chosen = known.filter(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # `rows` bounds the broadcast side.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(texts.join(F.broadcast(chosen), "doc_id"), f"{label}-sample")
