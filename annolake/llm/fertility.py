"""Quality rules from tokeniser fertility.

Each word is tokenised on its own with two public vocabularies: a byte-level one and one of
pieces with byte fallback. A document's measures are characters per token of both, the
share of byte-fallback pieces, and the entropy of its byte-level tokens as a share of the
largest that so many tokens can have. Bands are found from the whole corpus, for each
language (each script where the language is missing) and size class, as quartiles widened
by WIDTHS times their distance; a document outside a band is rejected. A group of less than
`least` documents takes the band of its neighbouring size classes, else of its language,
else of the corpus, so every document has a band. Besides, the base rules reject texts that
are short or repeat themselves.

Edge cases: null and empty texts have no words and fail the base rules; any length is read
whole; repeated rows get a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.llm.common import map_arrow, slices, stored
from annolake.llm.packing import byte_bpe
from annolake.llm.wordtable import WordTable, by_text

SYMBOL = re.compile(r"[#*$%&|<>]")
SPAN = 8
MEASURES = ("chars_per_token", "chars_per_piece", "byte_share", "entropy_share")
#: How many quartile distances a band reaches below and above the quartiles. Few distinct
#: tokens mark bad texts clearly; the other sides are kept wide, to spare good ones.
WIDTHS = {"chars_per_token": (5.0, 6.0), "chars_per_piece": (3.5, 5.0), "byte_share": (6.0, 4.0), "entropy_share": (2.0, 6.0)}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{m} double" for m in MEASURES) + ", own string"
#: Size classes (half octaves of words) that a group may borrow from, on each side.
NEAR = (0, 1, 2, 4)
#: First code points of ranges of scripts.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "japanese"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))


def repeated_words(ids: np.ndarray) -> int:
    """Words in SPAN-word windows that the sequence holds twice or more."""
    n = len(ids) - SPAN + 1
    if n < 2:
        return 0
    # Equal halves, then equal pairs of halves: numbers of 1-, 2-, 4- and 8-word windows.
    level, width = ids, 1
    while width < SPAN:
        pairs = level[: len(level) - width] << np.int64(32) | level[width:]
        level = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(level)[level] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + SPAN, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def may_repeat(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a text can hold a window twice: false is certain."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.cumsum(np.concatenate([[np.uint64(0)], mixed * np.uint64(0xC2B2AE3D27D4EB4F)]), dtype=np.uint64)
    window = total[SPAN:] - total[:-SPAN] if len(total) > SPAN else total[:0]  # the words of a window, in any order
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[: len(window)] == text[SPAN - 1 :] if len(window) else np.zeros(0, bool)
    key = (window[inside] >> np.uint64(24)) | (text[: len(window)][inside].astype(np.uint64) << np.uint64(40))
    values, many = np.unique(key, return_counts=True)
    out = np.zeros(len(counts), bool)
    out[np.unique((values[many > 1] >> np.uint64(40)).astype(np.int64))] = True
    return out


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), "<u4")
    if not len(points):
        return "none"
    place = np.searchsorted([x for x, _ in SCRIPTS], points, "right") - 1
    return SCRIPTS[int(np.bincount(place).argmax())][1]


class Meter:
    """Measures texts; words are tokenised once and remembered."""

    def __init__(self, bytes_file: str, pieces_file: str):
        import sentencepiece

        self.pattern, self.ids = byte_bpe(bytes_file)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.pieces.get_piece_size())])
        self.forget()
        self.table = WordTable(self.tokenise, 6, 150_000, self.forget)

    def forget(self) -> None:
        self.tokens, self.held = np.zeros(0, np.int64), 0

    def tokenise(self, fresh: list[str]) -> np.ndarray:
        """Characters, symbols, pieces, byte pieces, place and number of byte-level tokens."""
        data = [b"".join(map(self.ids.__getitem__, self.pattern.findall(" " + w))) for w in fresh]
        n = np.array([len(d) // 4 for d in data])
        first = len(self.tokens) + np.cumsum(n) - n
        self.tokens = np.concatenate([self.tokens, np.frombuffer(b"".join(data), "<u4").astype(np.int64)])
        split = self.pieces.encode(fresh, num_threads=1)
        pieces = np.array([len(p) for p in split])
        flat = self.is_byte[np.array([x for p in split for x in p], np.int64)]
        byte = by_text(np.add, flat.astype(np.int64), pieces)
        return np.stack([[len(w) for w in fresh], [len(SYMBOL.findall(w)) for w in fresh], pieces, byte, first, n], axis=1)

    def measure(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        ids, n = self.table.numbered(texts)
        rows = self.table.rows[ids].astype(np.int64)
        sums = by_text(np.add, rows, n)
        size = rows[:, 5]
        token = self.tokens[np.repeat(rows[:, 4] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        text = np.repeat(np.repeat(np.arange(len(n)), n), size)
        keys, many = np.unique(text << 20 | token, return_counts=True)
        tokens = sums[:, 5]
        share = many / tokens[keys >> 20]
        entropy = np.bincount(keys >> 20, -share * np.log2(share), minlength=len(n))
        repeats, ends = may_repeat(ids, n), np.cumsum(n)
        safe = lambda a, b: a / np.maximum(b, 1)
        return {
            "n_words": n, "word_chars": sums[:, 0], "n_symbols": sums[:, 1],
            "n_dup_lines": [duplicate_lines(t) if "\n" in t else 0 for t in texts],
            "n_repeat_words": [repeated_words(ids[ends[k] - n[k] : ends[k]]) if repeats[k] else 0 for k in range(len(n))],
            "chars_per_token": safe(sums[:, 0], tokens), "chars_per_piece": safe(sums[:, 0], sums[:, 2]), "byte_share": safe(sums[:, 3], sums[:, 2]),
            "entropy_share": entropy / np.log2(np.maximum(tokens, 2)),
        }


@cache
def meter(bytes_file: str, pieces_file: str) -> Meter:
    return Meter(bytes_file, pieces_file)


def measured(docs: DataFrame, bytes_file: str, pieces_file: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.float64()] * 4
        for batch in batches:
            known, at = batch.column(2).to_pylist(), 0
            for keys, texts in slices(batch, 2_000_000):
                found = meter(bytes_file, pieces_file).measure(texts)
                own = [script_of(t) if known[at + k] is None else known[at + k] for k, t in enumerate(texts)]
                at += len(keys)
                columns = [pa.array(x, t) for x, t in zip((keys, *found.values()), types)]
                yield pa.record_batch([*columns, pa.array(own, pa.string())], ["doc_id", *found, "own"])

    return map_arrow(docs.select("doc_id", "text", "lang"), run, SCHEMA)


def bands_of(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(own, class, band): the band of each group; (own, class, band): the groups whose documents a band is made of.

    A band is the first of these that holds `least` documents: the group alone, with size
    classes up to NEAR away, the language or script, the corpus.
    """
    counts = rows.groupBy("own", "class").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("own")
    held = [F.sum("n").over(own.orderBy("class").rangeBetween(-k, k)) for k in NEAR] + [F.sum("n").over(own)]
    language, corpus = len(NEAR), len(NEAR) + 1
    scope = F.coalesce(*[F.when(h >= least, k) for k, h in enumerate(held)], F.lit(corpus))
    name = F.concat_ws("|", "scope", F.when(F.col("scope") < corpus, F.col("own")), F.when(F.col("scope") < language, F.col("class")))
    groups = stored(counts.withColumn("scope", scope).withColumn("band", name).select("own", "class", "scope", "band"), "fertility-groups")
    source = groups.select("own", "class")
    reach = F.element_at(F.array(*map(F.lit, NEAR)), F.col("scope") + 1)
    near = groups.filter(F.col("scope") < language).select("own", "band", F.col("class").alias("middle"), reach.alias("reach"))
    near = source.join(near, "own").filter(F.abs(F.col("class") - F.col("middle")) <= F.col("reach")).select("own", "class", "band")
    whole = source.join(groups.filter(F.col("scope") == language).select("own", "band").distinct(), "own")
    every = source.crossJoin(groups.filter(F.col("scope") == corpus).select("band").distinct())
    return groups.drop("scope"), near.unionByName(whole).unionByName(every)


def fertility_rules(docs: DataFrame, bytes_file: str, pieces_file: str, widths: dict[str, tuple[float, float]] = WIDTHS, least: int = 30) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the measures and the first band that a document is outside of."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = stored(measured(docs, bytes_file, pieces_file).withColumn("class", F.floor(2 * F.log2(F.col("n_words") + 1))), "fertility")
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 2000).alias(m) for m in MEASURES]
    groups, feeds = bands_of(rows, least)
    bands = rows.join(F.broadcast(feeds), ["own", "class"]).groupBy("band").agg(*quartiles)
    limits = []
    for m in MEASURES:
        low, high = F.col(m)[0], F.col(m)[1]
        spread = F.greatest(high - low, 0.02 * high)
        limits += [(low - widths[m][0] * spread).alias(f"{m}_low"), (high + widths[m][1] * spread).alias(f"{m}_high")]
    bands = F.broadcast(groups.join(bands.select("band", *limits), "band").drop("band"))
    outside = F.coalesce(*[F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in MEASURES])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.join(bands, ["own", "class"]).withColumn("outside", outside).select(*base, failed.alias("base_failed"), (~failed & F.col("outside").isNull()).alias("kept"), *MEASURES, "outside")

