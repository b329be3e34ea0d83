"""Document-level relation records: tokens split at entity boundaries, sentences, places in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.functions.text import word_characters
from annolake.operators.intervals import at_or_before, held

SENTENCE = r"[^.!?]+[.!?]*\s*|[.!?]+\s*"


def with_enough_entities(entities: DataFrame, least: int = 5) -> DataFrame:
    return entities.join(entities.groupBy("paper_id").count().filter(F.col("count") >= least).select("paper_id"), "paper_id", "left_semi")


def split_tokens(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """paper_id, location, s, e, tok: tokens without white space, cut where an entity starts or ends within."""
    cuts = entities.select("paper_id", "location", F.explode(F.array(F.col("start_idx"), F.col("end_idx") + 1)).alias("cut")).distinct()
    solid = tokens.filter(r"tok rlike '\\S'")
    inner = at_or_before(cuts, F.col("cut") - 1, solid, "s", {"s": "s", "e": "e"}).filter("cut < e").groupBy("paper_id", "location", "s").agg(F.collect_set("cut").alias("cuts"))
    places = F.array_sort(F.concat(F.array("s", "e"), F.coalesce("cuts", F.array().cast("array<int>"))))
    parts = solid.join(inner, ["paper_id", "location", "s"], "left").withColumn("p", places)
    made = parts.select("paper_id", "location", F.col("s").alias("first"), "tok", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.struct(F.element_at("p", k).alias("s"), F.element_at("p", k + 1).alias("e")))).alias("x"))
    return made.select("paper_id", "location", "x.s", "x.e", F.substring(F.col("tok"), F.col("x.s") - F.col("first") + 1, F.col("x.e") - F.col("x.s")).alias("tok"))


def merged_sentences(sentences: DataFrame, entities: DataFrame) -> DataFrame:
    """paper_id, location, sent_id, s, e: sentences (i, s, e), merged wherever an entity crosses an end."""
    crossed = held(sentences, F.col("e") - 1, entities, "start_idx", "end_idx", "reach").withColumn("cut", F.when(F.col("reach") >= F.col("e"), 1))
    section = Window.partitionBy("paper_id", "location").orderBy("i")
    marked = crossed.withColumn("begins", F.when(F.lag("cut").over(section) == 1, 0).otherwise(1))
    marked = marked.withColumn("sent_id", F.sum("begins").over(section.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy("paper_id", "location", "sent_id").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def sentence_tokens(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """Tokens with sent_id and pos, their rank in the sentence."""
    inside = at_or_before(tokens, "s", sentences, "s", {"sent_id": "sent_id", "_to": "e"}).filter("e <= _to").drop("_to")
    return inside.withColumn("pos", F.row_number().over(Window.partitionBy("paper_id", "location", "sent_id").orderBy("s")) - 1)


def placed_entities(entities: DataFrame, tokens: DataFrame, mode: str = "drop") -> DataFrame:
    """Entities with sent_id, first and end (exclusive) place; each boundary is a token's boundary. Others go, or (strict) are an error; see `rejects.placed_entities`."""
    from annolake.operators import rejects

    return rejects.routed(rejects.placed_entities(entities, tokens), "placed_entities", mode)[0]


def nested(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """title, sents, vertexSet: a record each section; entities of one uri are one vertex, those without are vertices of their own."""
    sents = tokens.groupBy("paper_id", "location", "sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("words"))
    sents = sents.groupBy("paper_id", "location").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "words"))), lambda x: x["words"]).alias("sents"))
    mention = F.struct(F.array("first", "end").alias("pos"), F.col("label").alias("type"), "sent_id", F.col("text_span").alias("name"))
    key = F.when(F.col("uri").isin("-1", "NA"), F.concat(F.lit("#"), F.col("ord"))).otherwise(F.col("uri"))
    vertices = entities.withColumn("vertex", key).groupBy("paper_id", "location", "vertex").agg(F.min("ord").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("ord", mention.alias("x")))), lambda x: x["x"]).alias("mentions"))
    vertices = vertices.groupBy("paper_id", "location").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vertex", "mentions"))), lambda x: x["mentions"]).alias("vertexSet"))
    return sents.join(vertices, ["paper_id", "location"], "left").select(F.concat_ws("-", "paper_id", "location").alias("title"), "sents", "vertexSet")


# --- whole sections: the same places, told of a text and its entities' list in the task that holds both

SPACE = " \t\n\x0b\f\r"
SENTENCES = re.compile(SENTENCE.replace(r"\s", f"[{SPACE}]"))
NIL = ("-1", "NA")


@dataclass
class Section:
    """Tokens (s, e), cut at entities and within one sentence each, with their sentence's number and their rank in it; and of each entity sent_id, first and end (-1: not placed)."""

    s: np.ndarray
    e: np.ndarray
    sent: np.ndarray
    pos: np.ndarray
    sent_id: np.ndarray
    first: np.ndarray
    end: np.ndarray


def section_of(text: str, starts: np.ndarray, ends: np.ndarray) -> Section:
    """starts, ends: places of entities, ends inclusive. As `split_tokens`, `merged_sentences`, `sentence_tokens` and `placed_entities`."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = np.where(np.isin(codes, [ord(x) for x in SPACE]), np.int8(2), word_characters()[codes])
    at = np.flatnonzero(np.diff(kind, prepend=np.int8(-1)))
    to = np.append(at[1:], len(codes))
    s, e = at[kind[at] != 2], to[kind[at] != 2]
    cuts = np.unique(np.concatenate([starts, ends + 1]))
    own = np.searchsorted(s, cuts) - 1
    cuts = cuts[(own >= 0) & (cuts < np.append(e, 0)[own])]
    parts = np.sort(np.concatenate([s, cuts]))
    token = np.searchsorted(s, parts, "right") - 1
    to = e[token]
    same = token[1:] == token[:-1]
    to[:-1][same] = parts[1:][same]

    last = np.fromiter((m.end() for m in SENTENCES.finditer(text)), np.int64)
    order = np.argsort(starts, kind="stable")
    begun = np.searchsorted(starts[order], last - 1, "right")
    reach = np.concatenate([[-1], np.maximum.accumulate(ends[order])])[begun]
    opens = np.concatenate([[True], reach[:-1] < last[:-1]])[: len(last)]
    began = np.concatenate([[0], last[:-1]])[: len(last)][opens]
    sent = np.searchsorted(began, parts, "right") - 1
    inside = to <= np.append(began[1:], last[-1:])[sent]
    s, e, sent = parts[inside], to[inside], sent[inside]
    new = np.flatnonzero(np.diff(sent, prepend=-1))
    pos = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))

    a, b = np.searchsorted(s, starts), np.searchsorted(e, ends + 1)
    met = (np.append(s, -1)[a] == starts) & (np.append(e, -1)[b] == ends + 1)
    met &= np.append(sent, -1)[a] == np.append(sent, -2)[b]
    pick = lambda values, at: np.where(met, np.append(values, -1)[at], -1)
    return Section(s, e, sent, pos, pick(sent, a), pick(pos, a), pick(pos + 1, b))


def enough_lists(lists: DataFrame, least: int = 5) -> DataFrame:
    """As `with_enough_entities`, of lists of entities (a row a section)."""
    whole = F.sum(F.size("start_idx")).over(Window.partitionBy("paper_id"))
    return lists.withColumn("_n", whole).filter(F.col("_n") >= least).drop("_n")


def numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    """A row's list; none for null."""
    values = batch.column(column)[row].values
    return np.zeros(0, np.int64) if values is None else values.to_numpy(zero_copy_only=False).astype(np.int64)


def placed_lists(sections: DataFrame) -> DataFrame:
    """sections (paper_id, location, text, lists start_idx, end_idx, ord) to paper_id, location, ord, sent_id, first, end of the entities that are placed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for k in range(batch.num_rows):
                own = section_of(batch.column("text")[k].as_py() or "", numbers(batch, "start_idx", k), numbers(batch, "end_idx", k))
                some = own.sent_id >= 0
                rows.append(np.full(some.sum(), k))
                made.append([x[some] for x in (numbers(batch, "ord", k), own.sent_id, own.first, own.end)])
            columns = [np.concatenate(x) for x in zip(*made)] if made else [[]] * 4
            names = batch.select(["paper_id", "location"]).take(pa.array(np.concatenate(rows) if rows else [], pa.int64()))
            yield pa.record_batch([*names.columns, *(pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32())))], ["paper_id", "location", "ord", "sent_id", "first", "end"])

    some = sections.filter("start_idx is not null and text is not null").select("paper_id", "location", "text", "start_idx", "end_idx", "ord")
    return some.mapInArrow(run, "paper_id string, location string, ord int, sent_id long, first int, end int")


MENTION = "struct<pos: array<int>, type: string, sent_id: bigint, name: string>"


def nested_lists(sections: DataFrame) -> DataFrame:
    """As `nested`, of sections (paper_id, location, text, lists start_idx, end_idx, label, uri, ord; null lists: none)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = _parse_datatype_string(f"title string, sents array<array<string>>, vertexSet array<array<{MENTION}>>")

    def vertices(own: Section, text: str, starts, ends, labels, uris, ords) -> list | None:
        """The vertices by the first of their entities, and their mentions in order."""
        found: dict[str, list] = {}
        for k in np.flatnonzero(own.sent_id >= 0).tolist():
            key = uris[k] if uris[k] is not None and uris[k] not in NIL else f"#{ords[k]}"
            mention = {"pos": [int(own.first[k]), int(own.end[k])], "type": labels[k], "sent_id": int(own.sent_id[k]), "name": text[starts[k] : ends[k] + 1]}
            found.setdefault(key, []).append((ords[k], mention))
        ranked = sorted((min(x[0] for x in mine), key, sorted(mine, key=lambda x: x[0])) for key, mine in found.items())
        return [[m for _, m in mine] for _, _, mine in ranked] or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(shape)
        for batch in batches:
            titles, sents, sets = [], [], []
            for k in range(batch.num_rows):
                paper, location, text = (batch.column(c)[k].as_py() for c in ("paper_id", "location", "text"))
                starts, ends, ords = (numbers(batch, c, k) for c in ("start_idx", "end_idx", "ord"))
                own = section_of(text, starts, ends)
                if not len(own.s):
                    continue
                cut = [*np.flatnonzero(np.diff(own.sent, prepend=-1)).tolist(), len(own.s)]
                words = [text[a:b] for a, b in zip(own.s.tolist(), own.e.tolist())]
                titles.append(f"{paper}-{location}")
                sents.append([words[a:b] for a, b in zip(cut, cut[1:])])
                sets.append(vertices(own, text, starts.tolist(), ends.tolist(), *(batch.column(c)[k].as_py() for c in ("label", "uri")), ords.tolist()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip((titles, sents, sets), arrow.types)], schema=arrow)

    some = sections.filter("paper_id is not null and text <> ''").select("paper_id", "location", "text", "start_idx", "end_idx", "label", "uri", "ord")
    return some.mapInArrow(run, shape)
