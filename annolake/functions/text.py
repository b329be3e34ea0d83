"""Column functions on text: markers, label parsing, JSON and prompt strings."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from annolake.schema import LABELS


@cache
def word_characters() -> np.ndarray:
    """Whether a code point is a letter, a number or '_'."""
    return np.fromiter((c == 95 or unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000).view(np.int8)


def part(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], 0-based."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def mark_entity(text: Column, start: Column, end: Column) -> Column:
    """[E1]…[/E1] around a span (end inclusive)."""
    size = F.length(text)
    return F.concat(part(text, F.lit(0), start), F.lit("[E1]"), part(text, start, end + 1), F.lit("[/E1]"), part(text, end + 1, size))


def mark_pair(text: Column, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """[E1] around the subject, [E2] around the object, whichever comes first; touching spans stay apart."""
    size = F.length(text)

    def around(a, b, c, d, x, y):
        return F.concat(part(text, F.lit(0), a), F.lit(f"[{x}]"), part(text, a, b + 1), F.lit(f"[/{x}]"), part(text, b + 1, c), F.lit(f"[{y}]"), part(text, c, d + 1), F.lit(f"[/{y}]"), part(text, d + 1, size))

    return F.when(s1 < s2, around(s1, e1, s2, e2, "E1", "E2")).otherwise(around(s2, e2, s1, e1, "E2", "E1"))


def mark_pair_bytes(data: Column, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """As `mark_pair`, of a text in UTF-8 with places in bytes (ends exclusive; see spans.byte_places): parts of bytes are cut without a walk over characters."""
    cut = lambda a, b: F.substring(data, a + 1, F.greatest(b - a, F.lit(0)))
    mark = lambda x: F.lit(x.encode())

    def around(a, b, c, d, x, y):
        return F.concat(cut(F.lit(0), a), mark(f"[{x}]"), cut(a, b), mark(f"[/{x}]"), cut(b, c), mark(f"[{y}]"), cut(c, d), mark(f"[/{y}]"), cut(d, F.octet_length(data)))

    return F.when(s1 < s2, around(s1, e1, s2, e2, "E1", "E2")).otherwise(around(s2, e2, s1, e1, "E2", "E1"))


def mark_pair_context(window: int, first: str, second: str, first_mark: str, second_mark: str) -> Column:
    """Two marked spans with `window` characters around each (see spans.with_context), " … " for what is left out between.

    first, second: prefixes of the columns start_idx, end_idx, before, text_span and after; the first span comes first.
    """
    gap = F.col(f"{second}_start_idx") - F.col(f"{first}_end_idx") - 1
    after = F.col(f"{first}_after")
    between = F.when(gap <= 2 * window, F.substring(after, F.lit(1), gap)).otherwise(F.concat(F.substring(after, 1, window), F.lit(" … "), f"{second}_before"))
    return F.concat(f"{first}_before", F.lit(f"[{first_mark}]"), f"{first}_text_span", F.lit(f"[/{first_mark}]"), between, F.lit(f"[{second_mark}]"), f"{second}_text_span", F.lit(f"[/{second_mark}]"), F.substring(f"{second}_after", 1, window))


def marked_tokens(marked: Column, most: int) -> Column:
    """The first `most` tokens of a marked text: markers, words and single other characters."""
    return F.slice(F.regexp_extract_all(marked, F.lit(r"\[/?E[12]\]|\w+|[^\w\s]"), F.lit(0)), 1, most)


def keeps_markers(tokens: Column, *markers: str) -> Column:
    """Whether both opening markers (or those given) are among the tokens, so that no cut has lost one."""
    kept = [F.array_contains(tokens, m) for m in markers or ("[E1]", "[E2]")]
    return F.coalesce(F.array_size(F.filter(F.array(*kept), lambda x: x)) == len(kept), F.lit(False))


def parse_label(response: Column, labels: list[str] = LABELS, longest: bool = True) -> Column:
    """The first line as a label: equal but for case, else the longest label that it holds, else NA.

    longest=False: of several labels that it holds the first of the list, whatever their length.
    """
    line = F.lower(F.trim(F.split_part(response, F.lit("\n"), F.lit(1))))
    order = sorted(labels, key=lambda x: (-len(x), x)) if longest else labels
    exact = F.coalesce(*[F.when(line == x.lower(), F.lit(x)) for x in labels])
    return F.coalesce(exact, *[F.when(F.contains(line, F.lit(x.lower())), F.lit(x)) for x in order], F.lit("NA"))


def split_term_label(line: Column) -> Column:
    """struct(term, label) at the first of the separators ' | ', ': ' and ' - ' that the line has."""
    out = None
    for sep in (" | ", ": ", " - "):
        at = F.instr(line, sep)
        found = F.struct(F.trim(F.substring(line, F.lit(1), at - 1)).alias("term"), F.trim(F.substring(line, at + len(sep), F.length(line))).alias("label"))
        out = F.when(at > 0, found) if out is None else out.when(at > 0, found)
    return out.otherwise(F.struct(F.trim(line).alias("term"), F.lit("NA").alias("label")))


def occurrences(text: Column, term: Column) -> Column:
    """Starts (0-based) of all non-overlapping occurrences, case-insensitive."""
    pieces = F.split(text, F.concat(F.lit("(?iu)"), F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    ends = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.array().cast("array<int>"), lambda acc, p: F.array_append(acc, F.length(p) + F.when(F.size(acc) > 0, F.element_at(acc, -1) + F.length(term)).otherwise(0)))
    return F.when(F.length(term) > 0, ends).otherwise(F.array().cast("array<int>"))


#: The short escapes of JSON; other control characters are written as \\u and four digits.
SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(value: Column) -> Column:
    """A JSON string literal, non-ASCII characters as they are."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    out = plain
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x1f]"), out).otherwise(plain), F.lit('"'))


def json_array(values: Column) -> Column:
    """A JSON array of given JSON texts, with ', ' between."""
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def prompt(template: str, text: Column) -> Column:
    """The template with {text} replaced; other braces stay."""
    return F.replace(F.lit(template), F.lit("{text}"), text)
