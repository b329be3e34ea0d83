"""Language-model scores of whole documents, and their unigram baseline.

1. Words of all training documents are counted (with one end token a document).
2. The most frequent words get numbers of the recurrent model's vocabulary; each other
   word is an unknown of one of SHAPES kinds, told by its letters and last character.
   Texts are kept as these numbers, two bytes a token.
3. The model is trained on every token of every training document, in ROUNDS rounds. A hash
   of the document deals it to a round, a shard and a place there; each shard trains a copy
   of the model, and copies are averaged at the round's end, weighted by their tokens. So
   the result does not depend on how rows lie in files or tasks. Shards grow in number with
   the corpus, beyond MAX_SHARDS in size; what comes to the driver is one model a round.
4. Each document is scored whole, the state carried to its end:
   log P = sum log P(number | state) + sum over unknown words log P(word | kind), with
   P(word | kind) = (c + 1) / (N_kind + V_kind + 1) from the corpus's counts.

The `table_words` most frequent words and their counts are broadcast (a bounded table);
counts of other words are joined, so all counts are exact.

Edge cases: null and empty texts have the end token only; any length is scored whole;
repeated rows are scored each; without training documents N = V = 0 and all words are
unknown; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm import recurrent
from annolake.llm.common import fold, map_arrow, pieces, slices, stored

END = "\n"  # cannot be a word
SHAPES = 10
TABLE_WORDS = 1 << 17
#: The broadcast table's words hold so many characters at most; longer words than TABLE_LENGTH are not in it.
TABLE_CHARS, TABLE_LENGTH = 8_000_000, 4_096
ROUNDS = 4
#: Tokens of a shard, about, until there are MAX_SHARDS of them (which bounds the copies to average).
SHARD_TOKENS, MAX_SHARDS = 1_000_000, 4_096
ROWS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, extra double, place long, ids binary, rest map<string, int>"


def shape(word: bytes) -> int:
    """Kind of an unknown word: 1 to SHAPES."""
    last = word[-1:]
    return 1 + 5 * (not word.isascii()) + (b".,!".find(last) + 1 or 4 * (last in b"#*$%&|"))


def shape_column(word: Column) -> Column:
    last = F.right(word, F.lit(1))
    kind = F.when(last == ".", 1).when(last == ",", 2).when(last == "!", 3).when(last.isin(*"#*$%&|"), 4).otherwise(0)
    return 1 + F.when(F.length(word) < F.octet_length(word), 5).otherwise(0) + kind


def word_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """word, c: of all documents, one end token each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        end = END.encode()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update((text or b"").lower().split())  # words, as `word_bytes` has them
                seen[end] += 1
                if len(seen) > flush:
                    yield out()
        yield out()

    return map_arrow(docs.select("text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Places(dict):
    """word (bytes) -> place in the table; other words: minus their kind."""

    def __missing__(self, word: bytes) -> int:
        return -shape(word)


class Vocabulary:
    """What scoring needs of the corpus, of bounded size."""

    def __init__(self, table: list[tuple[str, int]], total: int, distinct: int, kinds: dict[int, tuple[int, int]], ends: int):
        self.words = [w for w, _ in table]
        self.counts = np.array([c for _, c in table], float)
        self.total, self.distinct = total, distinct
        first = 1 + SHAPES
        self.known = min(len(table), recurrent.VOCABULARY - first)
        self.model_counts = np.zeros(recurrent.VOCABULARY)
        self.model_counts[0] = ends + 1
        self.kind_total = np.zeros(first)
        for k in range(1, first):
            n, v = kinds.get(k, (0, 0))
            self.model_counts[k] = n + 1
            self.kind_total[k] = n + v + 1
        self.model_counts[first : first + self.known] = self.counts[: self.known]

    def prepare(self) -> Places:
        """Made once in each process."""
        if not hasattr(self, "_places"):
            own = [w.encode() for w in self.words]
            self._places = Places(zip(own, range(len(own))))
            # The model's number of each place, then (from the end) of each kind.
            listed = np.arange(len(self.words)) + 1 + SHAPES
            listed[self.known :] = [shape(w) for w in own[self.known :]]
            self._numbers = np.concatenate([listed, np.arange(SHAPES, 0, -1)])
        return self._places

    def numbers(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places in the table, negative for words outside; model numbers)."""
        at = np.fromiter(map(self.prepare().__getitem__, own), np.int64, len(own))
        return at, self._numbers[at]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}


def vocabulary(counts: DataFrame, table_words: int) -> Vocabulary:
    # The table is cut at a step of a logarithmic scale, so finding it moves few rows.
    listable = counts.filter((F.col("word") != END) & (F.length("word") <= TABLE_LENGTH)).withColumn("step", F.floor(64 * F.log2("c")))
    held, chars, least = 0, 0, 1 << 20
    for r in listable.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars")).orderBy(F.desc("step")).collect():  # some thousand rows at most
        held, chars = held + r["n"], chars + r["chars"]
        if held > table_words or chars > TABLE_CHARS:
            break
        least = r["step"]
    table = [(r["word"], r["c"]) for r in listable.filter(F.col("step") >= least).select("word", "c").collect()]  # `table_words` rows at most
    table.sort(key=lambda x: (-x[1], x[0]))
    sums = counts.groupBy(F.when(F.col("word") == END, 0).otherwise(shape_column(F.col("word"))).alias("kind")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    kinds = {r["kind"]: (r["n"], r["v"]) for r in sums}
    ends = kinds.pop(0, (0, 0))
    total, distinct = sum(n for n, _ in kinds.values()) + ends[0], sum(v for _, v in kinds.values()) + ends[1]
    for word, c in table[: recurrent.VOCABULARY - 1 - SHAPES]:  # these are no unknowns
        k = shape(word.encode())
        kinds[k] = (kinds[k][0] - c, kinds[k][1] - 1)
    return Vocabulary(table, total, distinct, kinds, ends[0])


def numbered(docs: DataFrame, shared) -> DataFrame:
    """A row (ROWS) each document: its numbers, and what its score has besides the model; `rest` holds the words that are not in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        row = TaskContext.get().partitionId() << 33
        unit = -math.log10(known.total + known.distinct + 1)
        end = math.log10(known.model_counts[0]) + unit  # its count + 1
        with np.errstate(divide="ignore"):
            kind_unit = -np.log10(known.kind_total)
        table_logs = np.log10(known.counts + 1)
        for batch in batches:
            held, first = batch.column(2), 0
            for keys, texts in slices(pa.record_batch([batch.column(0), batch.column(1).cast(pa.binary())], ["id", "text"]), 2_000_000, b""):
                parts = [t.lower().split() for t in texts]  # words, as `word_bytes` has them
                own, count = list(chain.from_iterable(parts)), len(parts)
                sizes = np.fromiter(map(len, parts), np.int64, count)
                text = np.repeat(np.arange(count), sizes)
                at, number = known.numbers(own)
                listed, unknown = at >= 0, number <= SHAPES
                logs = np.zeros(len(own))
                logs[listed] = table_logs[at[listed]]
                beyond = np.where(at >= known.known, logs, 0.0)
                beyond[unknown] += kind_unit[number[unknown]]
                by_text = lambda values: np.bincount(text, values, minlength=count)  # noqa: B023, E731
                # The numbers of all texts in one array, each text's end (0) after them.
                ids, ends = np.zeros(len(own) + count, "<u2"), np.cumsum(sizes + 1)
                ids[np.arange(len(own)) + text] = number
                data = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32)), pa.py_buffer(ids)])
                place = [xxhash.xxh3_64_intdigest(x.as_buffer(), seed=0 if key is None else key & 0xFFFFFFFF) >> 1 for key, x in zip(keys, data)]
                missed = np.flatnonzero(at < 0)
                found = Counter(zip(text[missed].tolist(), (own[k] for k in missed.tolist())))  # in the order of texts
                held_by = np.bincount([t for t, _ in found], minlength=count) if found else np.zeros(count, np.int64)
                pairs = pa.MapArray.from_arrays(np.concatenate([[0], np.cumsum(held_by)]).astype(np.int32), pa.array([w for _, w in found], pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int32()))
                yield pa.record_batch([
                    pa.array(range(row, row + count), pa.int64()), pa.array(keys, pa.int64()), held.slice(first, count), pa.array(sizes + 1), pa.array(np.bincount(text, listed, minlength=count).astype(np.int64) + int(known.model_counts[0] > 1)),
                    pa.array(unit * sizes + by_text(logs) + end), pa.array(by_text(beyond)), pa.array(place, pa.int64()), data, pairs,
                ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "extra", "place", "ids", "rest"])
                row, first = row + count, first + count

    return map_arrow(docs.select("doc_id", "text", "held_out"), run, ROWS)


COPIES = "block int, shard long, tokens long, values array<float>"


def copy_of(shard: int, trainer: recurrent.Trainer, block: int = 8192) -> pa.RecordBatch:
    """Rows (COPIES) of a trained copy, weighted by its tokens."""
    trainer.finish()
    values = recurrent.packed(trainer.w).astype(float) * trainer.tokens
    parts = [values[k : k + block].astype(np.float32) for k in range(0, len(values), block)]
    return pa.record_batch([pa.array(range(len(parts)), pa.int32()), *(pa.array([x] * len(parts), pa.int64()) for x in (shard, trainer.tokens)), pa.array(parts, pa.list_(pa.float32()))], ["block", "shard", "tokens", "values"])


def averaged_round(rows: DataFrame, model, shards: int) -> recurrent.Weights:
    """The average of the copies that the shards of rows (place, ids) train from `model`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trainer = None, None
        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != own:
                    if trainer:
                        yield copy_of(own, trainer)
                    own, trainer = shard, recurrent.Trainer(model.value)
                trainer.feed(np.frombuffer(ids.as_buffer(), "<u2").astype(np.int64))
        if trainer:
            yield copy_of(own, trainer)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums by block number: memory holds one model, whatever the number of copies.
        total: dict[int, list] = {}
        for batch in batches:
            for k, n, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                held = total.setdefault(k, [0, 0.0])
                held[0] += n
                held[1] = held[1] + v.values.to_numpy().astype(float)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int64()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([(x[1] / x[0]).astype(np.float32) for x in total.values()], pa.list_(pa.float32()))], ["block", "shard", "tokens", "values"])

    shard = F.pmod(F.shiftright("place", 8), F.lit(shards)).alias("shard")
    dealt = rows.select(shard, "place", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "place", "ids").select("shard", "ids")
    copies = map_arrow(dealt, run, COPIES).repartition(rows.sparkSession.sparkContext.defaultParallelism, "block").sortWithinPartitions("block", "shard")
    made = map_arrow(copies, mean, COPIES).toArrow().sort_by("block")  # one model
    return recurrent.unpacked(np.concatenate([np.array(v) for v in made.column("values").to_pylist()])) if len(made) else model.value


def trained(rows: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> recurrent.Weights:
    """The model after `rounds` rounds over rows (ROWS), each row in one of them."""
    context, w = rows.sparkSession.sparkContext, recurrent.initial(known.model_counts)
    shards = min(MAX_SHARDS, pieces(known.total, rounds * SHARD_TOKENS))
    for k in range(rounds):
        model = context.broadcast(w)
        w = averaged_round(rows.filter(F.pmod("place", F.lit(rounds)) == k), model, shards)
        model.unpersist()
    return w


def scored(rows: DataFrame, model) -> DataFrame:
    """row, score: the model's log10 probability of each row's numbers, the state carried through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in batch.column(1)]
            rest = batch.drop_columns(["ids"])
            yield rest.append_column("score", pa.array(recurrent.score(w, texts) / math.log(10)))

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, extra double, score double"
    names = [c.split()[0] for c in schema.split(", ")[:-1]]
    return map_arrow(rows.select(names[0], "ids", *names[1:]), run, schema)


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2, table_words: int = TABLE_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", folds) == held_out).alias("held_out"))
    counts = stored(word_counts(docs.filter("not held_out")), "word-counts")
    known = vocabulary(counts, table_words)
    rows = stored(numbered(docs, context.broadcast(known)), "numbered")
    model = context.broadcast(trained(rows.filter("not held_out"), known, rounds))
    # Words outside the table: their counts are joined; a word without one has count 0.
    rest = rows.select("row", F.explode("rest").alias("word", "n")).join(counts, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), F.sum("n").alias("more"))
    more = F.coalesce("logs", F.lit(0.0))
    return scored(rows, model).join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + F.col("extra") + more).alias("score"),
    )
