"""One-object JSON files ({key: object, ...}), read in many tasks whatever their layout, and written in order.

A file is split at its closing braces by the text reader, so its blocks are read by as many
tasks as it has. Whether a piece begins within a string, how deep it is nested, and on which
line it stands, follow from prefix sums over pieces: in each block first, then over the
blocks of a file, of which there are few. A member ends where a brace closes to the
outermost object; its pieces are joined again and parsed.

Values must be objects. A member that is no JSON, or has no object, is an error, where its key or
content is read, that names the file and the line it begins on; `strict=False` leaves it as a row with `error` instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = r'(?s)^[\s,]*+(?:\{\s*+)?("(?:[^"\\]++|\\.)*+")\s*+:\s*+(.*+)$'


def count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def outside(piece: Column, begins_inside: int) -> Column:
    """What of a piece is not in strings. Escapes are gone first; a piece cannot begin within one, as no escape holds a brace."""
    parts = F.split(F.regexp_replace(piece, r"\\.", ""), '"')
    return F.array_join(F.filter(parts, lambda _, k: k % 2 == begins_inside), "")


def pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, block, at, value of all pieces; what stands between two closing braces is one."""
    raw = spark.read.option("lineSep", "}").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def before(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with the sum of each value over all earlier pieces of the file: over those of the block, and over earlier blocks."""
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("file", "block").agg(*(F.sum(v).alias(f"_{c}") for c, v in values.items()))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in values))
    summed = df.withColumns({c: F.coalesce(F.sum(v).over(own), F.lit(0)) for c, v in values.items()})
    return summed.join(blocks, ["file", "block"]).select(*df.columns, *((F.col(c) + F.col(f"_{c}")).alias(c) for c in values))


def members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, ord (the member's place in its file), line (where it begins, from 1), key, value: the text of each member's object; error where there is none."""
    some = pieces(spark, paths)
    bare = F.regexp_replace("value", r"\\.", "")
    some = before(some.withColumn("quotes", count(bare, '"')), {"quoted": F.col("quotes"), "lines": count(F.col("value"), "\n")})
    inside = F.col("quoted") % 2
    text = F.when(inside == 1, outside(F.col("value"), 1)).otherwise(outside(F.col("value"), 0))
    closes = ((F.col("quoted") + F.col("quotes")) % 2 == 0).cast("int")  # whether the brace after the piece is one
    some = some.select("file", "block", "at", "value", "lines", (count(text, "{[") - count(text, "]")).alias("opened"), closes.alias("closes"))
    some = before(some, {"depth": F.col("opened") - F.col("closes")})
    some = some.withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") + F.col("opened") - 1 == 1)).cast("int"))
    some = before(some, {"member": F.col("ends")})
    # A last piece without a brace after it counts as if it had one; where an object is still open then, the file is cut off in its last member.
    cut = some.groupBy("file").agg(F.max("member").alias("ord"), F.sum(F.col("opened") - F.col("closes")).alias("open")).filter("open > 0").select("file", "ord", F.lit(True).alias("cut"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "}")
    first = F.min(F.struct("block", "at", "lines", "value"))
    # A member's line is that of its first character that is no space, comma or opening brace of the file.
    lead = F.regexp_extract(F.col("first.value"), r"^[\s,]*(?:\{\s*)?", 0)
    made = some.groupBy("file", F.col("member").alias("ord")).agg(joined.alias("text"), first.alias("first"), F.max("ends").alias("whole"))
    made = made.join(cut, ["file", "ord"], "left").withColumn("whole", F.when(F.col("cut"), 0).otherwise(F.col("whole")))
    made = made.select("file", "ord", (F.col("first.lines") + count(lead, "\n") + 1).alias("line"), "text", F.when(F.col("whole") == 1, F.concat("text", F.lit("}"))).otherwise(F.col("text")).alias("full"), "whole")
    rest = (F.col("whole") == 0) & F.col("full").rlike(r"^\s*\{?\s*\}?\s*$")  # what closes the outermost object, or an empty one
    key, value = (F.regexp_extract("full", KEY, k) for k in (1, 2))
    made = made.filter(~rest).select("file", "ord", "line", F.get_json_object(F.concat(F.lit('{"k":'), key, F.lit("}")), "$.k").alias("key"), value.alias("value"), "whole")
    error = F.when(F.col("whole") == 0, "no whole object").when(F.col("key").isNull(), "no key").when(~F.startswith("value", F.lit("{")), "no object")
    return made.withColumn("error", error).drop("whole")


def read_object(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """file, ord, line, key, content (of a DDL schema) and, if not strict, error of the members of one-object files."""
    made = members(spark, paths)
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    made = made.withColumn("content", parsed).withColumn("error", F.coalesce("error", F.when(F.col("content").isNull() | F.col("content._bad").isNotNull(), "no JSON")))
    made = made.withColumn("content", F.col("content").dropFields("_bad"))
    if not strict:
        return made.select("file", "ord", "line", "key", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")
    said = F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.col("error"))
    sound = lambda c: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.raise_error(said)).alias(c)
    return made.select("file", "ord", "line", sound("key"), sound("content"))


def write_object(df: DataFrame, path: str, key: str, value: str, order: str) -> None:
    """One JSON object {key: value} in order, as the one part file of a folder; value: a column of JSON text or a struct, each member a line.

    One task sorts and writes them, with spills and a batch at a time, as one file has one writer.
    """
    held = F.col(value) if dict(df.dtypes)[value] == "string" else F.to_json(value, {"ignoreNullFields": "false"})
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    lines = df.select(F.concat(name, F.lit(": "), held).alias("value"), F.col(order).alias("_order"))
    header = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # without members there is a file, too
    lines = lines.unionByName(header, allowMissingColumns=True).repartition(1).sortWithinPartitions(F.col("value").isNotNull(), "_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        last: str | None = None
        for batch in batches:
            rows = [x for x in batch.column(0).to_pylist() if x is not None]
            out = [] if last is None or not rows else [last + ","]
            out += [x + "," for x in rows[:-1]]
            if last is None and rows:
                out = ["{", *out]
            last = rows[-1] if rows else last
            yield pa.record_batch([pa.array(out, pa.string())], ["value"])
        yield pa.record_batch([pa.array(["{", "}"] if last is None else [last, "}"], pa.string())], ["value"])

    lines.mapInArrow(run, "value string").write.mode("errorifexists").text(path)
