"""Rows that cannot go on: set aside with a reason, or an error inside the plan.

A check adds `reject`, the reason why a row cannot be used (null: it can). Then `kept` goes on
without the others, `rejected` gives those as rows of one form for all operators (operator,
reason, row as JSON), and `strict` fails the job at the first of them, when it runs and where
it runs: no job of its own, nothing on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.operators.spans import SPAN, first_wins

REJECT = "reject"


def checked(df: DataFrame, **reasons: Column) -> DataFrame:
    """df with reject: the first of the reasons (name=condition) that holds; an earlier reject stays."""
    found = F.coalesce(*([F.col(REJECT)] if REJECT in df.columns else []), *[F.when(c, F.lit(r)) for r, c in reasons.items()], F.lit(None).cast("string"))
    return df.withColumn(REJECT, found)


def kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REJECT).isNull()).drop(REJECT)


def rejected(df: DataFrame, operator: str) -> DataFrame:
    """operator, reason, row (JSON, with nulls)."""
    rows = [c for c in df.columns if c != REJECT]
    return df.filter(F.col(REJECT).isNotNull()).select(F.lit(operator).alias("operator"), F.col(REJECT).alias("reason"), F.to_json(F.struct(*rows), {"ignoreNullFields": "false"}).alias("row"))


def strict(df: DataFrame, operator: str) -> DataFrame:
    """df without reject; a row that has one is an error of the task that meets it, which names the operator, the reason and the row.

    Rows pass through a function that the optimiser cannot see into: a filter with raise_error would be
    moved behind later filters, or dropped with an outer join, and rejects would be lost after all.
    """
    schema, at = df.drop(REJECT).schema, df.columns.index(REJECT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.column(at).null_count < batch.num_rows:
                bad = batch.column(at).is_valid().to_pylist().index(True)
                row = {c: batch.column(c)[bad].as_py() for c in batch.schema.names if c != REJECT}
                raise ValueError(f"{operator}: {batch.column(at)[bad].as_py()} for {json.dumps(row, default=str)}")
            yield batch.drop_columns([REJECT])

    return df.mapInArrow(run, schema)


def routed(df: DataFrame, operator: str, mode: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(what goes on, rejects): mode drop sets rejects aside, strict raises at the first."""
    if mode not in ("drop", "strict"):
        raise ValueError(f"mode must be drop or strict, not {mode}")
    return (strict(df, operator) if mode == "strict" else kept(df)), rejected(df, operator)


def gathered(*parts: DataFrame) -> DataFrame:
    """Rejects of several operators, as one table."""
    return reduce(DataFrame.unionByName, parts)


# --- checks of operators that join


def completed(relations: DataFrame, entities: DataFrame, sides: tuple[str, ...] = ("subject", "object")) -> DataFrame:
    """Relations with uri and text of both ends, checked: no entity at the subject's span, or at the object's."""
    first = first_wins(entities, SPAN, ["ord"])
    for side in sides:
        own = first.select("paper_id", "location", *(F.col(c).alias(f"{side}_{c}") for c in ("start_idx", "end_idx", "uri", "text_span")), F.lit(True).alias(f"_{side}"))
        relations = relations.join(own, ["paper_id", "location", f"{side}_start_idx", f"{side}_end_idx"], "left")
    return checked(relations, **{f"no {side}": F.col(f"_{side}").isNull() for side in sides}).drop(*[f"_{side}" for side in sides])


def placed_entities(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """Entities with sent_id, first and end (exclusive) place, checked: a boundary that is no token's, or two sentences."""
    starts = tokens.select("paper_id", "location", F.col("s").alias("start_idx"), F.col("sent_id"), F.col("pos").alias("first"))
    ends = tokens.select("paper_id", "location", (F.col("e") - 1).alias("end_idx"), F.col("sent_id").alias("_sent"), (F.col("pos") + 1).alias("end"))
    met = entities.join(starts, ["paper_id", "location", "start_idx"], "left").join(ends, ["paper_id", "location", "end_idx"], "left")
    return checked(met, **{"no token starts here": F.col("sent_id").isNull(), "no token ends here": F.col("_sent").isNull(), "crosses sentences": F.col("sent_id") != F.col("_sent")}).drop("_sent")


def labelled(terms: DataFrame, classes: DataFrame) -> DataFrame:
    """Terms with the label and confscore of classes (one a span), checked: no label."""
    met = terms.join(classes.select(*SPAN, "label", "confscore", F.lit(True).alias("_is")), SPAN, "left")
    return checked(met, **{"no label": F.col("_is").isNull()}).drop("_is")


def answered(responses: DataFrame) -> DataFrame:
    """Answers of a model (response, failure), checked: the reason of a failed call."""
    failed = F.concat(F.lit("failed: "), F.coalesce("failure", F.lit("no response")))
    return responses.withColumn(REJECT, F.when(F.col("response").isNull(), failed)).drop("failure")


def nil_sections(spans: DataFrame, responses: DataFrame, nil: str = "-1") -> DataFrame:
    """Spans to link with uri and reason: where the call for a section failed, all its spans are nil and say why.

    responses: paper_id, location, failure (null: it went well); a section that was never asked counts as failed.
    """
    said = responses.select("paper_id", "location", F.col("failure"), F.lit(True).alias("_asked"))
    met = spans.join(said, ["paper_id", "location"], "left")
    reason = F.when(F.col("_asked").isNull(), "not asked").otherwise(F.col("failure"))
    return met.withColumn("reason", reason).withColumn("uri", F.when(F.col("reason").isNotNull(), F.lit(nil)).otherwise(F.col("uri") if "uri" in spans.columns else F.lit(None).cast("string"))).drop("_asked", "failure")
