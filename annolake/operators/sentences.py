"""Sentence boundaries learnt from the corpus itself, without labels (after Kiss and Strunk, 2006).

A period after a word may end a sentence or belong to an abbreviation. `learnt` counts word
types over the whole collection and keeps what log-likelihood ratios tell:

- abbreviations: types that nearly always come with a period, the shorter the likelier;
- starters: types that follow a sentence's end far more often than they would by chance;
- pairs: an abbreviation, initial or number with its period and the word after it, that stay together;
- case: whether a type is seen in lower case, and with a capital in the middle of a sentence.

All of these follow from one table of counts by type, which one pass over the texts fills: words
are counted in their tasks before anything is shuffled. `split` then decides at each word that
may end a sentence from its own type and the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the method: score of an abbreviation, ratios of a starter and of a pair, and how often an abbreviation has its period.
ABBREVIATION, STARTER, PAIR, CERTAIN = 0.3, 30.0, 7.88, 0.99
OPENING, CLOSING = r"^[(\[{\"'‘“«]+", r"[)\]}\"'’”»]+$"
SECTION = ["paper_id", "location"]


@dataclass
class Learnt:
    abbreviations: DataFrame
    starters: DataFrame
    pairs: DataFrame
    cases: DataFrame


#: What may end a sentence, or belong to an abbreviation, within brackets and quotes; the exact rules look at such words only.
LAST = r"[.!?][)\]}\"'’”»]*$"


def kind(word: Column) -> dict[str, Column]:
    """type, period, stop, upper and lower of a word.

    The core is the word without brackets and quotes around it; type: it in lower case without its last period,
    '#' for digits; period: it ends with one, and not with several; stop: it ends with ! or ?.
    """
    core = F.regexp_replace(F.regexp_replace(word, OPENING, ""), CLOSING, "")
    period = core.rlike(r"[^.]\.$")
    bare = F.lower(F.when(period, F.left(core, F.length(core) - 1)).otherwise(core))
    return {"type": F.regexp_replace(bare, r"^\d+([.,]\d+)*$", "#"), "period": period, "stop": core.rlike(r"[!?]$"), "upper": core.rlike(r"^\p{Lu}"), "lower": core.rlike(r"^\p{Ll}")}


def words(texts: DataFrame, *columns: str) -> DataFrame:
    """columns, at (the word's number), tok, last (it may end a sentence), next and before (null at the ends) of words between white space, and before_last.

    A text's words are one array and its neighbours that array moved by one, so no row leaves its task.
    """
    own = texts.filter("text <> ''").select(*columns, F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("_w")).filter("size(_w) > 0")
    own = own.withColumn("_e", F.transform("_w", lambda x: x.rlike(LAST)))
    none = lambda kind: F.array(F.lit(None).cast(kind))
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size("_w") - 1).alias("at"), F.col("_w").alias("tok"), F.col("_e").alias("last"), F.concat(F.slice("_w", F.lit(2), F.size("_w")), none("string")).alias("next"), F.concat(none("string"), F.slice("_w", F.lit(1), F.size("_w") - 1)).alias("before"), F.concat(none("boolean"), F.slice("_e", F.lit(1), F.size("_w") - 1)).alias("before_last"))
    return own.select(*columns, F.inline(zipped))


def counted(texts: DataFrame) -> DataFrame:
    """type, period, stop, next (the type after a word that may end a sentence), n, n_lower, n_upper_middle: all that is learnt from.

    Words are counted as they stand first, with what is told by their neighbours; only the distinct ones are looked at closely.
    """
    other = kind(F.col("before"))  # looked at only where it may have ended a sentence
    middle = F.when(F.col("before").isNull(), False).when(~F.col("before_last"), True).otherwise(~(other["period"] | other["stop"]))
    raw = words(texts).groupBy("tok", F.when(F.col("last"), F.col("next")).alias("next"), middle.alias("middle")).agg(F.count(F.lit(1)).alias("n"))
    own = kind(F.col("tok"))
    made = raw.select("n", "middle", *(v.alias(c) for c, v in own.items()), kind(F.col("next"))["type"].alias("next"))
    keys = ["type", "period", "stop", F.when(F.col("period") | F.col("stop"), F.col("next")).alias("next")]
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return made.groupBy(*keys).agg(F.sum("n").alias("n"), some(F.col("lower")).alias("n_lower"), some(F.col("upper") & F.col("middle")).alias("n_upper_middle"))


def likelihood(hits: Column, rows: Column, p: Column) -> Column:
    """log of p^hits (1 - p)^(rows - hits)."""
    return F.when(hits == 0, F.lit(0.0)).otherwise(hits * F.log(p)) + F.when(rows == hits, F.lit(0.0)).otherwise((rows - hits) * F.log(1 - p))


def ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of two events that fall together `both` times; 0 where they do so less often than by chance."""
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    found = -2 * (likelihood(both, first, p) + likelihood(second - both, total - first, p) - likelihood(both, first, p1) - likelihood(second - both, total - first, p2))
    return F.when(both * total > first * second, found).otherwise(0.0)


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """type, n_with, n_without (a period), score of the types that have a letter and are seen with a period."""
    total, periods = counts.agg(F.sum("n"), F.sum(F.when(F.col("period"), F.col("n")).otherwise(0))).first()
    with_, without = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in (F.col("period"), ~F.col("period")))
    types = counts.filter(r"type rlike '\\p{L}'").groupBy("type").agg(with_.alias("n_with"), without.alias("n_without")).filter("n_with > 0")
    rows, hits = F.col("n_with") + F.col("n_without"), F.col("n_with")
    p = F.lit((periods or 0) / max(total or 0, 1))
    found = -2 * (likelihood(hits, rows, p) - likelihood(hits, rows, F.lit(CERTAIN)))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    dots = F.length("type") - letters + 1
    return types.withColumn("score", found * F.exp(-letters) * dots * F.pow(letters.cast("double"), -F.col("n_without").cast("double")))


def is_end(abbreviation: str = "abbreviation") -> Column:
    return F.col("stop") | (F.col("period") & F.col(abbreviation).isNull())


def marked(rows: DataFrame, abbreviations: DataFrame) -> DataFrame:
    return rows.join(abbreviations.select("type", F.lit(True).alias("abbreviation")), "type", "left")


def learnt(texts: DataFrame) -> Learnt:
    """From texts (text): all of them are counted, once; the counts by type are kept for the session."""
    counts = counted(texts).persist()
    abbreviations = abbreviation_scores(counts).filter(F.col("score") >= ABBREVIATION)
    known = marked(counts, abbreviations)
    total, ends = known.agg(F.sum("n"), F.sum(F.when(is_end(), F.col("n")).otherwise(0))).first()
    types = counts.groupBy("type").agg(F.sum("n").alias("n"), F.sum("n_lower").alias("n_lower"), F.sum("n_upper_middle").alias("n_upper_middle"))

    begun = known.filter(is_end() & F.col("next").isNotNull()).groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("hits")).filter(r"type rlike '\\p{L}'")
    starters = begun.join(types.select("type", "n"), "type").withColumn("ratio", ratio(F.col("hits"), F.lit(ends), F.col("n"), F.lit(total))).filter(F.col("ratio") >= STARTER)

    first = known.filter(F.col("period") & F.col("next").isNotNull() & (F.col("abbreviation").isNotNull() | F.col("type").rlike(r"^(#|\p{L})$")))
    both = first.groupBy("type", "next").agg(F.sum("n").alias("hits")).filter("hits > 1")
    pairs = both.join(types.select("type", "n"), "type").join(types.select(F.col("type").alias("next"), F.col("n").alias("n_next")), "next")
    pairs = pairs.withColumn("ratio", ratio(F.col("hits"), F.col("n"), F.col("n_next"), F.lit(total))).filter(F.col("ratio") >= PAIR)
    return Learnt(abbreviations, starters.select("type", "hits", "n", "ratio"), pairs.select("type", "next", "hits", "ratio"), types.select("type", "n_lower", "n_upper_middle"))


def ends(texts: DataFrame, known: Learnt) -> DataFrame:
    """paper_id, location, at: the words that end sentences. After ! or ?, and after a period unless an abbreviation, an initial or a pair tells otherwise.

    An abbreviation or initial ends one where the next word has a capital, and either is a starter or is
    known in lower case but never had a capital in the middle of a sentence. A text's last word is not told.
    """
    some = words(texts, *SECTION).filter(F.col("last") & F.col("next").isNotNull())
    own, after = kind(F.col("tok")), kind(F.col("next"))
    rows = some.select(*SECTION, "at", *(own[c].alias(c) for c in ("type", "period", "stop")), after["type"].alias("next"), after["upper"].alias("capital")).filter("period or stop")
    rows = marked(rows, known.abbreviations)
    rows = rows.join(known.starters.select(F.col("type").alias("next"), F.lit(True).alias("starter")), "next", "left")
    rows = rows.join(known.pairs.select("type", "next", F.lit(True).alias("pair")), ["type", "next"], "left")
    rows = rows.join(known.cases.filter("n_lower > 0 and n_upper_middle = 0").select(F.col("type").alias("next"), F.lit(True).alias("lowered")), "next", "left")
    short = F.col("abbreviation").isNotNull() | F.col("type").rlike(r"^\p{L}$")
    begins = F.col("capital") & (F.col("starter").isNotNull() | F.col("lowered").isNotNull())
    return rows.filter(F.col("stop") | (F.col("pair").isNull() & (~short | begins))).select(*SECTION, "at")


#: The words of Java's and RE2's patterns: white space is ASCII.
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def cut(text: str, ends: list[int]) -> Iterator[tuple[int, int]]:
    """(start, end) of sentences: each but the first begins with the word after one of `ends`, numbers of words in order."""
    begins = {k + 1 for k in ends}
    at = 0
    for k, m in enumerate(WORD.finditer(text)):
        if k in begins:
            yield at, m.start()
            at = m.start()
    yield at, len(text)


def split(texts: DataFrame, known: Learnt) -> DataFrame:
    """paper_id, location, i, tok, s, e: sentences that partition each text, as `segment.tokenise` gives tokens; white space belongs to the one before.

    Only words that may end a sentence leave their text; what they tell comes back as numbers of words.
    """
    told = ends(texts, known).groupBy(*SECTION).agg(F.collect_list("at").alias("ends"))
    own = texts.filter("text <> ''").select(*SECTION, "text").join(told, SECTION, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                paper, location, text, marks = (batch.column(c)[k].as_py() for c in range(4))
                spans = list(cut(text, marks or []))
                yield pa.record_batch([pa.array([paper] * len(spans), pa.string()), pa.array([location] * len(spans), pa.string()), pa.array(range(len(spans)), pa.int32()), pa.array([text[a:b] for a, b in spans], pa.string()), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())], ["paper_id", "location", "i", "tok", "s", "e"])

    return own.select(*SECTION, "text", "ends").mapInArrow(run, "paper_id string, location string, i int, tok string, s int, e int")
