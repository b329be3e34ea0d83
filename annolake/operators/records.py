"""Small operators between record forms: dictionaries, linking records, label and score rules, counts and sets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.operators.spans import SPAN


def as_terms(spans: DataFrame) -> DataFrame:
    """Every label becomes 'term'."""
    return spans.withColumn("label", F.lit("term"))


def with_fallback_label(spans: DataFrame, predicted: str = "predicted_label") -> DataFrame:
    """label: the classifier's where it has one, else the extractor's."""
    return spans.withColumn("label", F.coalesce(predicted, "label")).drop(predicted)


def numeric(score: Column) -> Column:
    """A score that counts in means: a number, or null for anything else (text that is no number, NaN)."""
    made = score.try_cast("double")
    return F.when(~F.isnan(made), made)


# --- concepts


def concept_rows(concepts: DataFrame, other_names: str = " Sinonimi: ") -> DataFrame:
    """id, name, description of concepts (id, names, definition): the first name, and the definition (else the first name) with the other names."""
    first = F.try_element_at("names", F.lit(1))
    rest = F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0)))
    more = F.when(F.size("names") > 1, F.concat(F.lit(other_names), F.array_join(rest, ", "))).otherwise("")
    return concepts.select("id", first.alias("name"), F.concat(F.coalesce("definition", first), more).alias("description"))


def dictionary_rows(dictionary: DataFrame) -> DataFrame:
    """id, name with underscores for spaces, and whether that changed it."""
    under = F.replace(F.col("name"), F.lit(" "), F.lit("_"))
    return dictionary.select("id", under.alias("name"), (under != F.col("name")).alias("changed"))


def uris_of(definitions: DataFrame, known: DataFrame) -> DataFrame:
    """definitions (definition_id, any others) with uri from known (definition_id, uri, one each); null where there is none."""
    return definitions.join(known.select("definition_id", "uri"), "definition_id", "left")


# --- linking records


def linking_records(entities: DataFrame, label: str = "uri", none: str = "-1", separator: str = "-") -> DataFrame:
    """id, entities: a record a section. Ends are exclusive, the label is a list of one: the uri, or another column such as the entity's label.

    separator: between paper and section in the id.
    """
    one = F.struct(F.col("start_idx").alias("start"), (F.col("end_idx") + 1).alias("end"), F.array(F.coalesce(label, F.lit(none))).alias("label"))
    return entities.groupBy(F.concat_ws(separator, "paper_id", "location").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("entities"))


def written_back(entities: DataFrame, answers: DataFrame, none: str = "-1") -> DataFrame:
    """entities with the uri that answers (SPAN, uri) give; of several the first by name, without any `none`."""
    best = answers.groupBy(*SPAN).agg(F.min("uri").alias("uri"))
    return entities.drop("uri").join(best, SPAN, "left").withColumn("uri", F.coalesce("uri", F.lit(none)))


def source_shares(linked: DataFrame, source: str = "uri_source") -> DataFrame:
    """source, n, share of all mentions."""
    total = linked.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return linked.groupBy(source).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select(source, "n", (F.col("n") / F.col("_total")).alias("share"))


# --- counts and sets


def removed(before: DataFrame, after: DataFrame, *group: str) -> DataFrame:
    """group, n (rows before), removed: how many a filter took away; groups that lost all of them stay."""
    kept = after.groupBy(*group).agg(F.count(F.lit(1)).alias("_kept"))
    counts = before.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(kept, list(group), "left") if group else counts.join(F.broadcast(kept))
    return met.select(*group, "n", (F.col("n") - F.coalesce("_kept", F.lit(0))).alias("removed"))


def failing(rows: DataFrame, passes: Column, *group: str) -> DataFrame:
    """group, n, removed: as `removed` for a filter that keeps rows where `passes`, which is not null, holds; rows are read once."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(~passes).alias("removed"))


def set_sizes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """op, n: sizes of the union, the intersection and both differences of two sets of rows, in one pass over both.

    'fp' is what only b has, 'fn' what only a has.
    """
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    rows = both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    counts = rows.agg(F.count(F.lit(1)).alias("union"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("intersect"), F.count_if(F.col("_a") == 0).alias("fp"), F.count_if(F.col("_b") == 0).alias("fn"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("op"), F.col(c).alias("n")) for c in ("union", "intersect", "fp", "fn")])))


def entity_tokens(covered: DataFrame) -> DataFrame:
    """A row each token of entities with first_tok and last_tok (see `segment.covered_tokens`): tok."""
    return covered.withColumn("tok", F.explode(F.sequence("first_tok", "last_tok"))).drop("first_tok", "last_tok")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Frames below each other, columns by name; what one lacks is null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
