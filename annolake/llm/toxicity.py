"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon holds whole words and stems that mark the toxic rows of a bounded labelled
sample, one text of each family of near copies. Its trie is intersected with Levenshtein automata of 0 to 2 edits (by the length
of a term) and determinised as words are read, so misspelled terms are found in one walk
over a word. Each find is weighed by its context: quotation marks, words of reporting and
words of address within a window tell quoted from directed use. A logistic model of the
weighed finds, fitted on the same sample, gives the score.

Edge cases: null and empty texts have no finds and get the score of such texts; any length
of text is read whole; repeated rows get a row each; without labelled rows, or with one
class only, the lexicon is empty and the score is the smoothed share of toxic rows; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import Cache, fold, map_arrow, row_slices, slices, word_hash, words
from annolake.llm.labelled import SAMPLE_ROWS, training_rows

TRIM = ".,;:!?\"'()[]{}*#$%&|<>-_~`^=+/\\…«»“”„‘’¿¡"
QUOTES = frozenset("\"'`«»“”„‘’")
#: Words of reporting and of address, in four languages.
REPORTING = frozenset("said says wrote writes called quoted quote term word definition defined means dit écrit mot terme cité sagte schrieb wort begriff zitat dijo escribió palabra término cita".split())
ADDRESS = frozenset("you your you're u du dich dir dein deine euch tu toi te vous votre ton tú usted tus ustedes vosotros".split())
WINDOW = 6

Term = tuple[str, bool]  # text, whether it is a stem


def normal(word: str) -> str:
    return word.strip(TRIM).lower()


def edits_of(term: Term) -> int:
    """Edits that a term allows, by its length."""
    text, stem = term
    return (len(text) >= 6) if stem else (len(text) >= 5) + (len(text) >= 8)


class Automaton:
    """The product of a trie of terms and Levenshtein automata, determinised as it is used.

    A state is a set of (trie node, edits so far), plus the stems already read in full with
    their edits. At most `states` are remembered, the first ones met: these are the short
    prefixes that most words share. Later ones are worked out when they are needed.
    """

    def __init__(self, terms: list[Term], states: int = 4_000):
        self.terms, self.limit = terms, states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed: list[int] = [0]
        for k, term in enumerate(terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], edits_of(term))
            for c in term[0]:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits_of(term))
            self.ends[node].append(k)
        self.known: dict[tuple, tuple] = {}
        self.start = self._state({0: 0}, {})

    def _state(self, nodes: dict[int, int], stems: dict[int, int]) -> tuple:
        """Closes over skipped lexicon letters; returns (transitions, find, nodes, stems)."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        stems = dict(stems)
        found = [(e, k) for k, e in stems.items()]
        for node, e in nodes.items():
            for k in self.ends[node]:
                if e <= edits_of(self.terms[k]):
                    found.append((e, k))
                    if self.terms[k][1] and e < stems.get(k, 9):
                        stems[k] = e
        key = (frozenset(nodes.items()), frozenset(stems.items()))
        state = self.known.get(key)
        if state is None:
            full = len(self.known) >= self.limit
            state = (None if full else {}, min(found, default=None), nodes, stems)
            if not full:
                self.known[key] = state
        return state

    def _step(self, state: tuple, c: str) -> tuple:
        nodes: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < nodes.get(node, 9):
                nodes[node] = e

        for node, e in state[2].items():
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        return self._state(nodes, state[3])

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the closest term in a word; ties go to the first term."""
        state = self.start
        for c in word:
            # A state that isn't remembered (transitions: None) is not kept as a target either.
            after = state[0].get(c) if state[0] is not None else None
            if after is None:
                after = self._step(state, c)
                if state[0] is not None and after[0] is not None:
                    state[0][c] = after
            state = after
            if not state[2]:
                break
        return state[1] if word else None


def context(own: list[str], at: int) -> tuple[float, bool]:
    """Weight of a find by the words around it, and whether it is quoted."""
    around = own[max(0, at - WINDOW) : at] + own[at + 1 : at + 1 + WINDOW]
    near = {normal(w) for w in around}
    before, after = own[max(0, at - WINDOW) : at + 1], own[at : at + 1 + WINDOW]
    quoted = any(w[0] in QUOTES for w in before) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
    return (0.3 if quoted else 1.0) * (0.6 if near & REPORTING else 1.0) * (1.3 if near & ADDRESS else 1.0), quoted


@lru_cache(4)
def finder(terms: tuple[Term, ...]) -> Cache:
    automaton = Automaton(list(terms))
    return Cache(lambda word: automaton.find(normal(word)), 150_000)


def finds(text: str, terms: tuple[Term, ...]) -> list[tuple[int, int, float, bool]]:
    """(edits, term, weight, quoted) of each find in a text."""
    own = words(text)
    found = list(map(finder(terms).__getitem__, own))
    return [(*hit, *context(own, k)) for k, hit in enumerate(found) if hit] if any(found) else []


def features(hits: list[tuple[int, int, float, bool]]) -> list[float]:
    exact = [w for e, _, w, _ in hits if e == 0]
    near = [w for e, _, w, _ in hits if e == 1]
    far = [w for e, _, w, _ in hits if e == 2]
    return [1.0, max(exact, default=0), math.log1p(sum(exact)), max(near, default=0), math.log1p(sum(near)), max(far, default=0), math.log1p(sum(far))]


def families(sample: DataFrame, bands: int = 6, wide: int = 3, n: int = 5) -> DataFrame:
    """One row, the smallest doc_id, of each family of near copies and label in a bounded sample.

    The range of shingle hashes has `wide` parts a band, and rows are of one family when the
    smallest hashes of all parts of a band agree (98 % of pairs with a similarity of 0.8, 1 %
    with 0.1), so that the words of a text that was copied often count once. The hashes of
    the sample, SAMPLE_ROWS rows at most, go to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for text in batch.column(2).to_pylist():
                own = words(text, lower=True)
                least: dict[int, int] = {}
                for k in range(max(1, len(own) - n + 1)):
                    mark = word_hash(" ".join(own[k : k + n])) >> 1
                    part = mark % (wide * bands)
                    least[part] = min(mark, least.get(part, mark))
                own_bands = [[least.get(wide * k + j, -1) for j in range(wide)] for k in range(bands)]
                marks.append([f"{k}:{band}" for k, band in enumerate(own_bands) if max(band) >= 0])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(marks, pa.list_(pa.string()))], ["doc_id", "label", "marks"])

    rows = map_arrow(sample.select("doc_id", "label", "text"), run, "doc_id long, label int, marks array<string>").orderBy("doc_id", "label").collect()
    above: dict[tuple[int, str], tuple[int, str]] = {}

    def root(x: tuple[int, str]) -> tuple[int, str]:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for r in rows:
        for mark in r["marks"]:
            above[root((r["label"], mark))] = root((r["label"], r["marks"][0]))
    kept: dict[tuple[int, str], int] = {}
    for r in rows:
        kept.setdefault(root((r["label"], r["marks"][0])), r["doc_id"])
    chosen = sample.sparkSession.createDataFrame([(k,) for k in sorted(set(kept.values()))], "doc_id long")
    return sample.join(F.broadcast(chosen), "doc_id")


def mine(sample: DataFrame, most: int = 500) -> list[Term]:
    """Words and stems that mark toxic rows, by the likelihood ratio; `most` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in {normal(w) for w in words(text)}:
                    seen.setdefault(word, [0, 0])[label] += 1
        seen.pop("", None)
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], ["term", "clean", "toxic"])

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(totals) < 2:
        return []
    share = totals[1] / (totals[0] + totals[1])
    counts = map_arrow(sample.select("label", "text"), count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    stems = counts.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.when(F.length("term") > n, F.substring("term", F.lit(1), n)))).alias("stem"), "clean", "toxic").dropna()
    stems = stems.groupBy(F.col("stem").alias("term")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count_if(F.expr("toxic > 0 and clean = 0")).alias("kinds")).filter("kinds >= 4").drop("kinds")
    both = counts.withColumn("stem", F.lit(False)).unionByName(stems.withColumn("stem", F.lit(True))).filter("toxic >= 3 and length(term) >= 3 and toxic >= 9 * clean")
    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    ratio = 2 * (F.col("toxic") * F.log(p / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - share))).otherwise(0))
    rows = both.withColumn("ratio", ratio).filter("ratio >= 24").orderBy(F.desc("ratio"), "term", "stem").limit(most).collect()
    found = {r["term"]: r["toxic"] for r in rows if r["stem"]}
    chosen: list[str] = []
    for stem in sorted(found, key=len):
        if not any(stem.startswith(x) for x in chosen):
            # The longest stem that still has nearly all that the shortest has.
            chosen.append(max((x for x in found if x.startswith(stem) and found[x] >= 0.9 * found[stem]), key=lambda x: (len(x), x)))
    whole = [r["term"] for r in rows if not r["stem"] and not any(r["term"].startswith(x) for x in chosen)]
    return [(x, True) for x in sorted(set(chosen))] + [(x, False) for x in sorted(whole)]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton's method with an L2 penalty on all but the first weight."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: DataFrame) -> tuple[tuple[Term, ...], list[float]]:
    """Lexicon and weights of the logistic model."""
    terms = tuple(mine(families(sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(finds(t, terms)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = map_arrow(sample.select("label", "text"), run, "label int, x array<double>").groupBy("label", "x").count().orderBy("label", "x").collect()
    if not rows:
        return (), [-3.0] + [0.0] * 6
    n = np.array([r["count"] for r in rows])
    return terms, logistic(np.repeat(np.array([r["x"] for r in rows]), n, axis=0), np.repeat(np.array([r["label"] for r in rows], float), n)).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, n_quoted."""
    terms, weights = fit(training_rows(docs, labels, "toxic", rows=rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch):
                hits = [finds(t, terms) for t in texts]
                z = np.array([features(h) for h in hits]) @ np.array(weights)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array([len(h) for h in hits], pa.int32()), pa.array([sum(x[3] for x in h) for h in hits], pa.int32())], ["doc_id", "score", "n_hits", "n_quoted"])

    made = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, n_hits int, n_quoted int")
    return made.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted")


def clean(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    terms, weights = fit(training_rows(docs, labels, "toxic", rows=rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in row_slices(batch)):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            z = np.array([features(finds(t or "", terms)) for t in texts]) @ np.array(weights)
            yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
