"""Terms anchored to all their places in a text: one pass over a text for all of its terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = ["paper_id", "location"]
#: Rows given at once.
ROWS = 50_000


def folded(text: str) -> str:
    """In lower case, character by character, so that places stay: one that would become several stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def places(text: str, terms: list[str]) -> list[tuple[int, int, int]]:
    """(number of the term, start, end) of each term's occurrences from left to right that don't overlap, whatever the case; empty terms have none."""
    automaton = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        if term:
            low = folded(term)
            automaton.add_word(low, [*automaton.get(low, []), k])
    if not len(automaton):
        return []
    automaton.make_automaton()
    free, out = [0] * len(terms), []
    for last, numbers in automaton.iter(folded(text)):
        for k in numbers:
            start = last + 1 - len(terms[k])
            if start >= free[k]:
                free[k] = last + 1
                out.append((k, start, last + 1))
    return sorted(out)


def anchored(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """terms (paper_id, location, term, any others) once for each occurrence: start_idx, end_idx (inclusive), text_span as the text has it.

    A section's terms meet its text in one row, so the text is read once whatever their number;
    terms without a place go. Terms of one section are held together, as its text is.
    """
    grouped = terms.filter("term <> ''").groupBy(*SECTION).agg(F.collect_set("term").alias("_terms"))
    met = grouped.join(texts.select(*SECTION, "text"), SECTION).select(*SECTION, "text", "_terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                paper, location, text, own = (batch.column(c)[k].as_py() for c in range(4))
                rows += [(paper, location, own[n], s, e - 1, text[s:e]) for n, s, e in places(text or "", own)]
                while len(rows) >= ROWS:
                    yield made(rows[:ROWS])
                    rows = rows[ROWS:]
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        own = list(zip(*rows)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.record_batch([pa.array(x, t) for x, t in zip(own, kinds)], [*SECTION, "term", "start_idx", "end_idx", "text_span"])

    found = met.mapInArrow(run, "paper_id string, location string, term string, start_idx int, end_idx int, text_span string")
    return found.join(terms, [*SECTION, "term"])
