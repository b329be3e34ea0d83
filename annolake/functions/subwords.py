"""Subword pieces with places in the text: greedy longest match in a vocabulary, and its inverse.

Words are split as `segment` does; each is cut from the left into the longest pieces that the
vocabulary has. Pieces within a word carry `continues` in front ("##"), or the last one of a
word carries `ends` behind it ("</w>"), as public vocabularies do. A word that cannot be cut
whole is one unknown piece, so nothing of the text is lost: places always cover all words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.operators.intervals import at_or_before, touched

SECTION = ["paper_id", "location"]
#: Rows given at once; words whose pieces are kept.
ROWS, KNOWN = 50_000, 50_000


@dataclass
class Vocabulary:
    """pieces: text to id. continues, ends: the marks of pieces within a word and of a word's last piece; unknown: the piece for the rest."""

    pieces: dict[str, int]
    continues: str = "##"
    ends: str = ""
    unknown: str = "[UNK]"
    lower: bool = False
    most: int = 200  # a longer word is unknown
    longest_piece: int | None = field(default=None, repr=False)

    def longest(self, word: str, start: int) -> tuple[str, int] | None:
        """The longest piece of a word at a place, and where it ends."""
        inner, size = start > 0 and bool(self.continues), len(word)
        for k in range(min(size, start + self.reach()), start, -1):
            piece = self.continues + word[start:k] if inner else word[start:k]
            if self.continues and not inner and piece.startswith(self.continues):
                continue
            if self.ends and k == size and piece + self.ends in self.pieces:
                return piece + self.ends, k
            # A bare piece stands within a word only, where last pieces are marked.
            if piece in self.pieces and (not self.ends or (k == size) == piece.endswith(self.ends)):
                return piece, k
        return None

    def reach(self) -> int:
        if self.longest_piece is None:
            self.longest_piece = max(map(len, self.pieces), default=0)
        return self.longest_piece

    def cut(self, word: str) -> list[tuple[str, int, int]]:
        """(piece, start, end) of a word."""
        folded = word.lower() if self.lower and len(word.lower()) == len(word) else word
        out, at = [], 0
        while at < len(word) and len(word) <= self.most:
            found = self.longest(folded, at)
            if not found:
                break
            out.append((found[0], at, found[1]))
            at = found[1]
        return out if out and at == len(word) else [(self.unknown, 0, len(word))]


def pieces(texts: DataFrame, vocabulary: Vocabulary, words: str = r"\w+|[^\w\s]") -> DataFrame:
    """paper_id, location, i, piece, id (null: not in the vocabulary), word (its number in the section), s, e of all pieces of texts."""
    pattern = re.compile(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[str, list] = {}
        out: list[tuple] = []
        for batch in batches:
            for paper, location, text in zip(*(c.to_pylist() for c in batch.columns)):
                i = 0
                for n, m in enumerate(pattern.finditer(text or "")):
                    word = m[0]
                    if word not in known:
                        if len(known) >= 200_000:
                            known.clear()
                        known[word] = vocabulary.cut(word)
                    for p, a, b in known[word]:
                        out.append((paper, location, i, p, vocabulary.pieces.get(p), n, m.start() + a, m.start() + b))
                        i += 1
                    if len(out) >= ROWS:
                        yield made(out)
                        out = []
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["paper_id", "location", "i", "piece", "id", "word", "s", "e"])

    return texts.select(*SECTION, "text").mapInArrow(run, "paper_id string, location string, i int, piece string, id int, word int, s int, e int")


def piece_lists(texts: DataFrame, vocabulary: Vocabulary, words: str = r"\w+|[^\w\s]") -> DataFrame:
    """The same pieces, a row a section with at least one: paper_id, location and lists of piece, id, word, s, e, in order. Nothing is shuffled."""
    pattern = re.compile(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            held, size = [], 0
            for row in zip(*batch.columns):
                paper, location, text = (x.as_py() for x in row)
                if found := list(pattern.finditer(text or "")):
                    held.append((paper, location, [m[0] for m in found], [m.start() for m in found]))
                    size += len(found)
                if size >= ROWS:
                    yield lists(held, known)
                    held, size = [], 0
            if held:
                yield lists(held, known)

    def lists(held: list[tuple], known: dict[str, list]) -> pa.RecordBatch:
        said = [w for x in held for w in x[2]]
        place = {w: k for k, w in enumerate(dict.fromkeys(said))}
        if len(known) >= KNOWN:
            known.clear()
        for w in place:
            if w not in known:
                known[w] = vocabulary.cut(w)
        # Each word's pieces stand once in `flat`; `at` finds those of all words in turn.
        flat = [x for w in place for x in known[w]]
        count = np.fromiter((len(known[w]) for w in place), np.int64, len(place))
        which = np.fromiter(map(place.__getitem__, said), np.int64, len(said))
        n = count[which]
        at = np.arange(n.sum()) + np.repeat((np.cumsum(count) - count)[which] - (np.cumsum(n) - n), n)
        starts = np.repeat(np.fromiter((s for x in held for s in x[3]), np.int64, len(said)), n)
        s, e = (starts + np.fromiter((x[k] for x in flat), np.int64, len(flat))[at] for k in (1, 2))
        sizes = np.fromiter((len(x[2]) for x in held), np.int64, len(held))
        word = np.repeat(np.arange(len(said)) - np.repeat(np.cumsum(sizes) - sizes, sizes), n)
        ends = np.concatenate([[0], np.cumsum(n)[np.cumsum(sizes) - 1]])
        columns = [pa.array([x[0] for x in flat], pa.string()).take(pa.array(at)), pa.array([vocabulary.pieces.get(x[0]) for x in flat], pa.int32()).take(pa.array(at)), *(pa.array(x, pa.int32()) for x in (word, s, e))]
        made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in columns]
        return pa.record_batch([*(pa.array([x[k] for x in held], pa.string()) for k in (0, 1)), *made], [*SECTION, "piece", "id", "word", "s", "e"])

    return texts.select(*SECTION, "text").mapInArrow(run, "paper_id string, location string, piece array<string>, id array<int>, word array<int>, s array<int>, e array<int>")


def joined_list(continues: str = "##", ends: str = "") -> Column:
    """The text that the lists of a row of `piece_lists` join to, as `joined` has it."""
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice("e", 1, F.size("e") - 1))

    def plain(x: Column) -> Column:
        bare = F.when(F.startswith(x, F.lit(continues)), F.substring(x, F.lit(len(continues) + 1), F.length(x))).otherwise(x) if continues else x
        return F.when(F.endswith(bare, F.lit(ends)), F.left(bare, F.length(bare) - len(ends))).otherwise(bare) if ends else bare

    spaced = F.zip_with("piece", F.zip_with(before, "s", lambda e, s: e < s), lambda x, apart: F.concat(F.when(apart, " ").otherwise(""), plain(x)))
    return F.array_join(spaced, "")


def joined(parts: DataFrame, continues: str = "##", ends: str = "", by: list[str] | None = None) -> DataFrame:
    """by, text: pieces (i, piece, s, e) as text again; marks go, and a space stands where places are apart.

    With places, the gap between two pieces is one space however wide it is; without the marks of
    `continues`, a piece that begins where the one before ends is its continuation.
    """
    by = by or SECTION
    plain = F.col("piece")
    plain = F.when(F.startswith("piece", F.lit(continues)), F.expr(f"substring(piece, {len(continues) + 1})")).otherwise(plain) if continues else plain
    plain = F.when(F.endswith(plain, F.lit(ends)), F.left(plain, F.length(plain) - len(ends))).otherwise(plain) if ends else plain
    apart = F.lag("e").over(Window.partitionBy(*by).orderBy("i")) < F.col("s")
    spaced = parts.withColumn("_piece", F.concat(F.when(apart, " ").otherwise(""), plain))
    return spaced.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "_piece"))), lambda x: x["_piece"]), "").alias("text"))


def word_labels(parts: DataFrame, labels: str, inner: Column | None = None) -> DataFrame:
    """parts with `aligned`: the label of a word's first piece; the others get `inner` (null: none, as a loss leaves them out)."""
    first = F.row_number().over(Window.partitionBy(*SECTION, "word").orderBy("i")) == 1
    return parts.withColumn("aligned", F.when(first, F.col(labels)).otherwise(F.lit(None) if inner is None else inner))


def labelled_words(parts: DataFrame, label: str, score: str | None = None) -> DataFrame:
    """paper_id, location, word, s, e, label (and score) of words: those of the first piece of each."""
    of_first = lambda c: F.min_by(c, "i").alias(c)
    return parts.groupBy(*SECTION, "word").agg(F.min("s").alias("s"), F.max("e").alias("e"), of_first(label), *([of_first(score)] if score else []))


def entity_pieces(parts: DataFrame, entities: DataFrame) -> DataFrame:
    """entities with the first and the last piece that they touch, by a sweep over places."""
    return touched(entities, "start_idx", "end_idx", parts.select(*SECTION, "i", "s", "e"), "i").withColumnsRenamed({"first": "first_piece", "last": "last_piece"})


def piece_at(places: DataFrame, at: str, parts: DataFrame) -> DataFrame:
    """places with the number of the piece that holds each (null: between pieces)."""
    met = at_or_before(places, at, parts, "s", {"piece_no": "i", "_e": "e"})
    return met.withColumn("piece_no", F.when(F.col(at) < F.col("_e"), F.col("piece_no"))).drop("_e")
