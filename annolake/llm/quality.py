"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its distinct words, hashed into `WORD_BUCKETS` and scaled to unit
length, and statistics of its structure and size, each put in one of `BINS` ranges whose
limits are quantiles of the sample. The score is the sigmoid of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

all pairwise interactions in time linear in the features. It is fitted by Adagrad on a
bounded sample of labelled rows.

Edge cases: null and empty texts have the statistics of a text without words and are
scored as such; any length is read whole; repeated rows get a row each; without labelled
rows of both classes, all get the smoothed share of good rows; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import fold, map_arrow, slices, word_hash
from annolake.llm.labelled import SAMPLE_ROWS, training_rows
from annolake.llm.wordtable import WordTable, by_text

WORD_BUCKETS, BINS, RANK, BLOCK = 4096, 8, 6, 48
SYMBOLS = frozenset("#*$%&|<>")


def properties(word: str) -> tuple:
    letters = sum(c.isalpha() for c in word)
    upper = sum(c.isupper() for c in word)
    symbols = sum(c in SYMBOLS for c in word)
    return (
        word_hash(word.strip(".,;:!?\"'()").lower()) % WORD_BUCKETS,
        len(word), letters, upper, symbols,
        symbols > 0, word.endswith("!"), letters > 1 and upper == letters,
        sum(c.isdigit() for c in word), not word.isascii(), word[-1] in ".!?",
    )


_table = WordTable(lambda fresh: [properties(w) for w in fresh], 11, 100_000)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all texts end to end, how many each has, and a row of statistics each."""
    ids, n = _table.numbered(texts)
    rows, doc = _table.rows[ids], np.repeat(np.arange(len(n)), n)
    some = np.maximum(n, 1)
    share = lambda values: by_text(np.add, values.astype(float), n) / some
    again = np.zeros(len(ids), bool)
    if len(ids):
        again[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.unique(doc << np.int64(32) | ids)
    kinds = np.bincount(distinct >> 32, minlength=len(n))
    # Blocks of words: what holds for a part of a text only.
    at = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    blocks = -(-n // BLOCK)
    block = at // BLOCK + np.repeat(np.cumsum(blocks) - blocks, n)
    size = np.bincount(block, minlength=blocks.sum())
    worst = lambda values: by_text(np.maximum, np.bincount(block, values, minlength=blocks.sum()) / np.maximum(size, 1), blocks)
    in_block = np.bincount(np.unique(block << np.int64(32) | ids) >> 32, minlength=blocks.sum())
    least_kinds = by_text(np.minimum, (in_block + 3) / np.maximum(size + 3, 1), blocks, 1.0)
    letters = np.maximum(by_text(np.add, rows[:, 2], n), 1)
    lines = [t.split("\n") for t in texts]
    size_words = by_text(np.add, rows[:, 1], n)
    stats = np.stack([
        np.log1p(n), np.log1p([len(t) for t in texts]), size_words / some, kinds / some, least_kinds,
        share(again), worst(again), by_text(np.add, rows[:, 4], n) / np.maximum(size_words, 1), share(rows[:, 5]), worst(rows[:, 5]),
        share(rows[:, 6]), worst(rows[:, 6]), by_text(np.add, rows[:, 3], n) / letters, share(rows[:, 7]), worst(rows[:, 7]),
        share(rows[:, 8]), share(rows[:, 9]), share(rows[:, 10]), [1 - len(set(x)) / len(x) for x in lines], np.log1p([len(x) for x in lines]),
    ], axis=1)
    words = np.unique(distinct >> 32 << np.int64(13) | _table.rows[distinct & 0xFFFFFFFF, 0].astype(np.int64))
    return words & 8191, np.bincount(words >> 13, minlength=len(n)), stats


@dataclass
class Machine:
    bias: float
    limits: np.ndarray  # (statistics, BINS - 1)
    w: np.ndarray
    v: np.ndarray

    def inputs(self, words: np.ndarray, counts: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all texts end to end, and how many each has."""
        places = np.stack([np.searchsorted(x, stats[:, k], "right") for k, x in enumerate(self.limits)], axis=1)
        places = places + WORD_BUCKETS + BINS * np.arange(stats.shape[1])
        value = 1 / np.sqrt(np.maximum(counts, 1))
        total = counts + stats.shape[1]
        index, values = np.empty(total.sum(), np.int64), np.empty(total.sum())
        first = np.cumsum(total) - total
        rest = np.ones(len(index), bool)
        spots = first[:, None] + np.arange(stats.shape[1])
        rest[spots] = False
        index[spots], values[spots] = places, 0.3
        index[rest], values[rest] = words, np.repeat(value, counts)
        return index, values, total

    def margin(self, index: np.ndarray, values: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[index] * values[:, None]
        sums = by_text(np.add, vx, total)
        return self.bias + by_text(np.add, self.w[index] * values, total) + 0.5 * (sums**2 - by_text(np.add, vx**2, total)).sum(1), sums

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.inputs(*features(texts)))[0], -30, 30)))


def fit(words: np.ndarray, counts: np.ndarray, stats: np.ndarray, labels: np.ndarray, epochs: int | None = None, batch: int = 128, rate: float = 0.15, penalty: float = 2e-5) -> Machine:
    rng = np.random.default_rng(7)
    size = WORD_BUCKETS + BINS * stats.shape[1]
    share = (labels.sum() + 1) / (len(labels) + 2)
    limits = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(stats) else np.zeros((stats.shape[1], BINS - 1))
    m = Machine(float(np.log(share / (1 - share))), limits, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    if len(set(labels.tolist())) < 2:
        m.v[:] = 0
        return m
    index, values, total = m.inputs(words, counts, stats)
    ends = np.cumsum(total)
    epochs = epochs or max(12, min(100, 60_000 // len(labels)))  # small samples are read more often
    gw, gv = np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for some in (order[k : k + batch] for k in range(0, len(order), batch)):
            own = np.concatenate([np.arange(ends[d] - total[d], ends[d]) for d in some])
            i, x, t = index[own], values[own], total[some]
            z, sums = m.margin(i, x, t)
            d = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some), t)
            used, where = np.unique(i, return_inverse=True)
            w = np.bincount(where, d * x) + penalty * m.w[used]
            v = np.stack([np.bincount(where, d * x * (np.repeat(sums[:, f], t) - m.v[i, f] * x)) for f in range(RANK)], axis=1) + penalty * m.v[used]
            gw[used] += w**2
            gv[used] += v**2
            m.w[used] -= rate * w / np.sqrt(gw[used])
            m.v[used] -= 0.3 * rate * v / np.sqrt(gv[used])
            m.bias -= 0.05 * d.sum() / max(1, t.mean())
    return m


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. `rows` labelled rows at most fit the model."""
    sample = training_rows(docs, labels, "quality", rows=rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, stats = features(batch.column(1).to_pylist())
            parts = np.split(words, np.cumsum(counts)[:-1]) if len(counts) else []
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([p.tolist() for p in parts], pa.list_(pa.int32())), pa.array(stats.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "words", "stats"])

    found = map_arrow(sample.select("doc_id", "text", "label"), gather, "doc_id long, label int, words array<int>, stats array<double>").toArrow().sort_by("doc_id")
    counts = found.column("words").combine_chunks().value_lengths().to_numpy() if len(found) else np.zeros(0, np.int64)
    stats = np.array(found.column("stats").to_pylist()).reshape(len(found), -1) if len(found) else np.zeros((0, 20))
    words = np.array([w for row in found.column("words").to_pylist() for w in row], np.int64)
    machine = fit(words, counts.astype(np.int64), stats, found.column("label").to_numpy().astype(float))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by WORD_BUCKETS, BINS and RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch, 2_000_000):
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(shared.value.score(texts))], ["doc_id", "score"])

    made = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")
    return made.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
