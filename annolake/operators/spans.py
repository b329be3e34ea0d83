"""Operators on spans: sections, offsets, deduplication, overlaps, label filters, BIO merges.

Spans are half of a row: paper_id, location ('title' or 'abstract'), start_idx and end_idx
(inclusive, 0-based, in the section's text); `ord` is the place in the paper's list, on which
every first-wins and last-wins rule depends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.operators.intervals import inside
from annolake.schema import LABELS

SPAN = ["paper_id", "location", "start_idx", "end_idx"]


def sections(papers: DataFrame) -> DataFrame:
    """A row for the title and one for the abstract of each paper, empty ones included."""
    both = F.array(F.struct(F.lit("title").alias("location"), F.col("title").alias("text")), F.struct(F.lit("abstract").alias("location"), F.col("abstract").alias("text")))
    return papers.select("paper_id", F.explode(both).alias("part")).select("paper_id", "part.location", "part.text")


def title_and_abstract(papers: DataFrame) -> DataFrame:
    """title and abstract from `metadata`, else from the top level."""
    return papers.withColumns({c: F.coalesce(F.col(f"metadata.{c}"), F.col(c), F.lit("")) for c in ("title", "abstract")})


def shifted(spans: DataFrame, papers: DataFrame, back: bool = False) -> DataFrame:
    """Offsets in title + ' ' + abstract; back: from there to the section again."""
    size = papers.select("paper_id", (F.length("title") + 1).alias("_by"))
    move = F.when(F.col("location") == "abstract", F.col("_by")).otherwise(0) * (-1 if back else 1)
    return spans.join(size, "paper_id").withColumns({c: (F.col(c) + move).cast("int") for c in ("start_idx", "end_idx")}).drop("_by")


def span_text(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """text_span, cut anew from the section's text."""
    return spans.join(texts, ["paper_id", "location"]).withColumn("text_span", F.substring(F.col("text"), F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx") + 1)).drop("text")


def with_context(spans: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """Adds text_span, `before` (at most `window` characters before it) and `after` (twice as many), so that pairs need no whole texts."""
    start, end = F.col("start_idx"), F.col("end_idx")
    first = F.greatest(start - window, F.lit(0))
    known = span_text(spans, texts).join(texts, ["paper_id", "location"])
    return known.withColumns({"before": F.substring(F.col("text"), first + 1, start - first), "after": F.substring(F.col("text"), end + 2, F.lit(2 * window))}).drop("text")


def beside_texts(spans: DataFrame, texts: DataFrame, tell: Callable[[str, list[tuple[int, int]]], list[tuple]], schema: str) -> DataFrame:
    """spans with the columns of `schema`: what `tell` says of a section's text and some of its places (start_idx, end_idx), a tuple each.

    Texts and spans are dealt by paper and read in one order, a section's text before its spans. So a text
    is not repeated for each span, as a join repeats it. Spans without a section go.
    """
    key, own = ["paper_id", "location"], spans.columns
    rest = [c for c in own if c not in key]
    blank = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in rest]
    both = texts.select(*key, F.col("text").alias("_text"), *blank).unionByName(spans.select(*key, F.lit(None).cast("string").alias("_text"), *rest))
    both = both.filter("paper_id is not null and location is not null and (_text is not null or start_idx is not null)")
    lined = both.repartition("paper_id").sortWithinPartitions(*key, F.col("_text").isNull())
    names = [x.split()[0] for x in schema.split(",")]
    shape = spans.select(*own, *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(","))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section, held = None, []
        for batch in batches:
            papers, places = batch.column("paper_id").to_pylist(), batch.column("location").to_pylist()
            is_text = batch.column("_text").is_valid().to_pylist()
            starts, ends = (batch.column(c).to_pylist() for c in ("start_idx", "end_idx"))
            rows, said, k = [], [], 0
            while k < batch.num_rows:
                here = papers[k], places[k]
                if is_text[k]:
                    held = [*(held if here == section else []), batch.column("_text")[k].as_py()]
                    section, k = here, k + 1
                    continue
                b = k
                while b < batch.num_rows and not is_text[b] and (papers[b], places[b]) == here:
                    b += 1
                for text in held if here == section else []:
                    rows += range(k, b)
                    said += tell(text, list(zip(starts[k:b], ends[k:b])))
                k = b
            made = batch.select(own).take(pa.array(rows, pa.int64()))
            told = list(zip(*said)) if said else [[]] * len(names)
            yield pa.record_batch([*made.columns, *(pa.array(x, t) for x, t in zip(told, kinds))], [*own, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(shape[c].dataType) for c in names]
    return lined.mapInArrow(run, shape)


def byte_places(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """start_byte and end_byte (exclusive) of each distinct span in its section's UTF-8: counted once a span, however many pairs it is in."""
    own = spans.select(*SPAN).distinct().join(texts, ["paper_id", "location"])
    start = F.octet_length(F.substring(F.col("text"), F.lit(1), F.col("start_idx")))
    size = F.octet_length(F.substring(F.col("text"), F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx") + 1))
    return own.select(*SPAN, start.alias("start_byte"), (start + size).alias("end_byte"))


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, keys, [F.desc(c) for c in order])


def deduplicated(spans: DataFrame, *group: str) -> DataFrame:
    """The first span of each place; labels don't count."""
    return first_wins(spans, [*group, *SPAN], ["ord"])


def without_overlaps(spans: DataFrame, *group: str) -> DataFrame:
    """The longest span of each cluster of overlapping ones, ties to the first.

    A span that starts at or after the largest end so far begins a cluster, so spans that
    share one boundary character don't overlap.
    """
    section = Window.partitionBy(*group, "paper_id", "location").orderBy("start_idx", "ord")
    reach = F.max("end_idx").over(section.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_break", F.when(reach.isNull() | (F.col("start_idx") >= reach), 1).otherwise(0))
    marked = marked.withColumn("_cluster", F.sum("_break").over(section.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.col("end_idx") - F.col("start_idx")
    return first_wins(marked, [*group, "paper_id", "location", "_cluster"], [size.desc(), "start_idx", "ord"]).drop("_break", "_cluster")


def legal(spans: DataFrame, label: str = "label") -> DataFrame:
    return spans.filter(F.col(label).isin(LABELS))


def cleaned(spans: DataFrame, *group: str) -> DataFrame:
    """What scorers see of predictions: deduplicated, without overlaps, legal labels only, in this order."""
    return legal(without_overlaps(deduplicated(spans, *group), *group))


def overlapping_pairs(a: DataFrame, b: DataFrame) -> Column:
    """Inclusive overlap of two aliased spans, as for negative samples."""
    return (a["start_idx"] <= b["end_idx"]) & (b["start_idx"] <= a["end_idx"])


def out_of_bounds(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans with a reason: an unknown location, or offsets outside the section."""
    known = spans.join(texts, ["paper_id", "location"], "left")
    reason = F.when(~F.col("location").isin("title", "abstract"), "location").when(F.col("start_idx") < 0, "start").when(F.col("end_idx") >= F.length("text"), "end").when(F.col("start_idx") > F.col("end_idx"), "order")
    return known.withColumn("reason", reason).filter("reason is not null").drop("text")


def bio_tags(tokens: DataFrame, entities: DataFrame, typed: bool = False) -> DataFrame:
    """A tag each token: B where it starts an entity, I inside one, else O; of several, the last entity wins.

    An entity finds its first and last token by a sweep, so the work is the tokens in entities, not the pairs of a section.
    """
    tag = F.when(F.col("s") == F.col("_won.start_idx"), "B").otherwise("I")
    tag = F.concat_ws("-", tag, "_won.label") if typed else tag
    found = inside(entities.select(*SPAN, "ord", "label"), "start_idx", "end_idx", tokens.select("paper_id", "location", "i", "s", "e"), "i")
    each = found.select("paper_id", "location", "start_idx", "ord", "label", F.explode(F.sequence("first", "last")).alias("i"))
    won = each.groupBy("paper_id", "location", "i").agg(F.max_by(F.struct("start_idx", "label"), "ord").alias("_won"))
    return tokens.join(won, ["paper_id", "location", "i"], "left").withColumn("tag", F.when(F.col("_won").isNull(), "O").otherwise(tag)).drop("_won")


def merged_tags(tagged: DataFrame, typed: bool = False) -> DataFrame:
    """Spans of tagged tokens (i, s, e, tag, score), O left out before: B begins one, I extends it over any gap.

    typed: another label than that before begins one as well.
    """
    section = Window.partitionBy("paper_id", "location").orderBy("i")
    some = tagged.filter("tag <> 'O'").withColumns({"_prefix": F.substring("tag", 1, 1), "label": F.expr("substring(tag, 3)")})
    begins = (F.col("_prefix") == "B") | F.lag("i").over(section).isNull()
    if typed:
        begins = begins | (F.lag("label").over(section) != F.col("label"))
    some = some.withColumn("_span", F.sum(begins.cast("int")).over(section.rowsBetween(Window.unboundedPreceding, 0)))
    made = some.groupBy("paper_id", "location", "_span").agg(F.min("s").alias("start_idx"), (F.max_by("e", "i") - 1).alias("end_idx"), F.min_by("label", "i").alias("label"), F.avg("score").alias("confscore"))
    return made.drop("_span") if typed else made.drop("_span", "label")
