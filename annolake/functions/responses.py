"""Reading (term, label) pairs from free-form model answers, in column functions.

Stages, the first that gives something counts: a JSON array of objects; whole objects of an
array that was cut off or broken; a JSON array of strings; a bullet list; several lines;
a comma list; the whole answer as one term. Labels that are not of the scheme become NA.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolake.functions.text import split_term_label
from annolake.schema import LABELS

BULLET = r"^\s*(?:[-*•]|\d+[.)])\s*"
STRICT = {"allowSingleQuotes": "false", "allowBackslashEscapingAnyCharacter": "false"}
OBJECT = "struct<term:string,label:string>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pair(term: Column, label: Column) -> Column:
    return F.struct(strip(term).alias("term"), strip(F.coalesce(label, F.lit("NA"))).alias("label"))


def split_pair(line: Column) -> Column:
    found = split_term_label(strip(line))
    return pair(found["term"], found["label"])


def filled(pairs: Column) -> Column:
    """Those with a term; null if there is none."""
    some = F.filter(pairs, lambda x: x["term"] != "")
    return F.when(F.size(some) > 0, some)


def stages(response: Column) -> dict[str, Column]:
    """What each stage reads from a response (null: nothing), in the order that they are tried."""
    said = F.coalesce(response, F.lit(""))
    array = F.regexp_extract(said, r"(?s)\[.*?\]", 0)
    objects = F.when(array.rlike(r"^\[\s*\{"), F.from_json(array, f"array<{OBJECT}>", STRICT))
    pieces = F.transform(F.regexp_extract_all(said, F.lit(r"(?s)\{[^{}]*\}"), F.lit(0)), lambda x: F.from_json(x, OBJECT, STRICT))
    strings = F.when(array.rlike(r'^\[\s*"'), F.from_json(array, "array<string>", STRICT))
    lines = F.split(said, r"\r\n|[\n\r]")
    bullets = F.transform(F.filter(lines, lambda x: x.rlike(BULLET)), lambda x: split_pair(F.regexp_replace(x, BULLET, "")))
    plain = filled(F.transform(lines, split_pair))
    commas = F.when(F.contains(said, F.lit(",")), F.transform(F.split(said, ","), split_pair))
    whole = lambda x: pair(F.coalesce(x["term"], F.lit("")), x["label"])
    return {
        "objects": filled(F.transform(objects, whole)),
        "cut": filled(F.transform(pieces, whole)),
        "strings": filled(F.transform(strings, lambda x: pair(F.coalesce(x, F.lit("")), F.lit("NA")))),
        "bullets": filled(bullets),
        "lines": F.when(F.size(plain) > 1, plain),
        "commas": filled(commas),
        "whole": filled(F.array(pair(said, F.lit("NA")))),
    }


def term_label_pairs(response: Column) -> Column:
    """array of struct(term, label) that a response tells, labels as they are written."""
    return F.coalesce(*stages(response).values(), F.array().cast(f"array<{OBJECT}>"))


def known_label(label: Column, labels: list[str] = LABELS) -> Column:
    """The label of the scheme that is equal but for case and white space around it, else NA."""
    low = F.lower(strip(label))
    return F.coalesce(*[F.when(low == x.lower(), F.lit(x)) for x in labels], F.lit("NA"))
