"""Text segmentation: tokens that partition a text, word n-grams, token alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.operators.intervals import held, touched

WHITESPACE = r"\s+|\S+"
GLINER = r"[\p{L}\p{N}_]+|[.,!?;:'\"()\[\]{}<>]|\s+|\S"


#: Tokens whose ends are summed up at once.
BLOCK = 32


def sums(sizes: Column) -> Column:
    """Running sums of a short list: each is appended to those before it."""
    return F.slice(F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(2), F.size(sizes))


def with_ends(parts: DataFrame, pieces: str) -> DataFrame:
    """parts with `ends`: where each of the pieces (a list of texts, one after the other) ends.

    Ends are running sums within blocks, and of blocks. No Python: rows stay in their partitions, and whatever they are
    dealt by still holds after it.
    """
    block = lambda k: F.slice("_sizes", k * BLOCK + 1, F.lit(BLOCK))
    own = parts.withColumn("_sizes", F.transform(pieces, F.length))
    own = own.withColumn("_within", F.transform(F.sequence(F.lit(0), F.floor((F.size("_sizes") - 1) / BLOCK).cast("int")), lambda k: sums(block(k))))
    own = own.withColumn("_before", F.concat(F.array(F.lit(0)), sums(F.transform("_within", lambda x: F.element_at(x, -1)))))
    # Met by place, not looked up in a lambda: the optimiser would make the list anew for each element.
    both = F.filter(F.arrays_zip("_within", "_before"), lambda x: x["_within"].isNotNull())
    return own.withColumn("ends", F.flatten(F.transform(both, lambda x: F.transform(x["_within"], lambda e: e + x["_before"])))).drop("_sizes", "_within", "_before")


def long_words(texts: DataFrame, least: int) -> DataFrame:
    """paper_id, location, tok, s, e, ne: words of `least` characters or more, and the end of the next one (null: none).

    A text is cut behind each such word, and after the last one into what is left, so only these words are placed.
    """
    pattern = F.lit(rf"[\s\S]*?([\p{{L}}\p{{N}}_]{{{least},}})|[\s\S]+")
    parts = texts.filter("text <> ''").select("paper_id", "location", F.regexp_extract_all("text", pattern, F.lit(0)).alias("pieces"), F.regexp_extract_all("text", pattern, F.lit(1)).alias("tok"))
    both = F.arrays_zip("tok", F.col("ends").alias("e"), F.slice("ends", F.lit(2), F.size("ends")).alias("ne"), F.slice("tok", F.lit(2), F.size("tok")).alias("after"))
    each = with_ends(parts, "pieces").select("paper_id", "location", F.inline(both)).filter("tok <> ''")
    return each.select("paper_id", "location", "tok", (F.col("e") - F.length("tok")).alias("s"), "e", F.expr("case when after <> '' then ne end").alias("ne"))


def tokenise(texts: DataFrame, pattern: str) -> DataFrame:
    """paper_id, location, i, tok, s, e: the pattern partitions the text, so ends are running sums of lengths.

    A text's tokens are cut, numbered and placed in the task that reads it: nothing is shuffled.
    """
    parts = texts.filter("text <> ''").select("paper_id", "location", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("toks"))
    each = with_ends(parts, "toks").select("paper_id", "location", F.posexplode(F.arrays_zip("toks", "ends")).alias("i", "x"))
    return each.select("paper_id", "location", "i", F.col("x.toks").alias("tok"), (F.col("x.ends") - F.length("x.toks")).alias("s"), F.col("x.ends").alias("e"))


def solid(tokens: DataFrame) -> DataFrame:
    """Without white space; `i` is renumbered."""
    some = tokens.filter(r"tok rlike '\\S'")
    return some.withColumn("i", F.row_number().over(Window.partitionBy("paper_id", "location").orderBy("s")) - 1)


def ngrams(tokens: DataFrame, most: int) -> DataFrame:
    """Spans (start_idx, end_idx, n) of 1 to `most` words, by `most` leads over the section; `opens` and `closes` are their first and last characters."""
    section = Window.partitionBy("paper_id", "location").orderBy("i")
    ended = tokens.withColumn("_end", F.struct("e", F.right("tok", F.lit(1)).alias("closes")))
    led = ended.withColumns({f"end{n}": F.lead("_end", n - 1).over(section) for n in range(1, most + 1)})
    ends = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"end{n}").alias("end")) for n in range(1, most + 1)])
    made = led.select("paper_id", "location", F.col("s").alias("start_idx"), F.left("tok", F.lit(1)).alias("opens"), F.inline(ends)).filter("end is not null")
    return made.select("paper_id", "location", "start_idx", (F.col("end.e") - 1).alias("end_idx"), "n", "opens", "end.closes")


def covered_tokens(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """first and last token (and label) of each entity: the tokens that it touches."""
    own = entities.select("paper_id", "location", "start_idx", "end_idx", "ord", "label")
    return touched(own, "start_idx", "end_idx", tokens.select("paper_id", "location", "i", "s", "e"), "i").withColumnsRenamed({"first": "first_tok", "last": "last_tok"})


def free_spans(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """spans that share no character with an entity: none that begins by their end ends at or after their start."""
    met = held(spans, "end_idx", entities, "start_idx", "end_idx", "_reach")
    return met.filter("_reach is null or _reach < start_idx").drop("_reach")


def negative_spans(spans: DataFrame, entities: DataFrame, order: Column, opening: str = "(", closing: str = ")") -> DataFrame:
    """As many free spans (of `ngrams`) as a paper has entities, in a given order; none that begins with `opening` or ends with `closing`."""
    some = spans.filter((F.col("opens") != opening) & (F.col("closes") != closing))
    ranked = free_spans(some, entities).withColumn("_n", F.row_number().over(Window.partitionBy("paper_id").orderBy(order, "location", "start_idx", "end_idx")))
    return ranked.join(entities.groupBy("paper_id").agg(F.count(F.lit(1)).alias("_room")), "paper_id").filter("_n <= _room").drop("_n", "_room")
