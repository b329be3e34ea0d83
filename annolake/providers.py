"""Models as pluggable providers, called in Arrow batches; parsers of their responses.

A provider is any object with the methods that an operator needs; it is sent to the workers,
so it should make clients when first called there. One that has the plural method (`tag_all`,
`classify_all`, `chat_all`) gets whole lists, as a model on an accelerator wants them; else each
text is a call. Stand-ins that need no model are given.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions.digests import Contexts, marked_digests
from annolake.functions.responses import known_label, term_label_pairs
from annolake.functions.text import mark_entity, mark_pair, mark_pair_context, parse_label, prompt
from annolake.operators import relations, spans
from annolake.operators.anchors import anchored
from annolake.schema import LABELS, PREDICATES

WORD = re.compile(r"[^\W_]\w*|_\w*")


class Chat(Protocol):
    def chat_completion(self, system: str, user: str, temperature: float = 1.0) -> str: ...


class Spans(Protocol):
    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end (exclusive), label, score) of the candidates in each text; they may overlap."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Tagger(Protocol):
    def tag(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, BIO tag, score) of the tokens of a text."""


class Classifier(Protocol):
    """classify_places(text, [(start, end inclusive)]), if it has it, gives what `classify` gives of the text with each of the places marked.

    classify_pairs(text, places by their starts, window), if it has it, gives a function of pairs of places (numbers of the first ones, of the second ones,
    whether the first ones are the subjects) that tells something of the text around both, and choice(these, how many labels are allowed) the numbers
    of the labels and the scores.
    """

    def classify(self, text: str, allowed: list[str] | None = None) -> tuple[str, float]: ...


#: Providers by name; modules may add theirs.
REGISTRY: dict[str, type] = {}


def register(name: str):
    def add(kind: type) -> type:
        REGISTRY[name] = kind
        return kind

    return add


def build(name: str, **options):
    if name not in REGISTRY:
        raise ValueError(f"unknown provider: {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:6], 16)


@register("hash-tagger")
@dataclass
class HashTagger:
    """Tags words of four letters or more by their md5."""

    every: int = 7

    def tag(self, text: str) -> list[tuple[int, int, str, float]]:
        out = []
        for m in WORD.finditer(text):
            h = number("t|" + m[0].lower())
            if len(m[0]) >= 4 and h % self.every == 0:
                out.append((m.start(), m.end(), "B-" + LABELS[h % 13], h % 1000 / 1000))
        return out


@register("hash-classifier")
@dataclass
class HashClassifier:
    labels: list[str] = field(default_factory=lambda: LABELS)

    def classify(self, text: str, allowed: list[str] | None = None) -> tuple[str, float]:
        h = number(text)
        labels = allowed or self.labels
        return labels[h % len(labels)], h % 1000 / 1000

    def classify_pairs(self, text: str, places: list[tuple[int, int]], window: int) -> Callable[[np.ndarray, np.ndarray, bool], np.ndarray]:
        """Tells the hashes of what `marked_pairs` shows of pairs; the choice among their labels and the score follow from these (see `choice`)."""
        return Contexts(text, places, window).heads

    @staticmethod
    def choice(said: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return said % sizes, said % 1000 / 1000

    def classify_places(self, text: str, places: list[tuple[int, int]]) -> list[tuple[str, float]]:
        found = (int.from_bytes(x[:3], "big") for x in marked_digests(text, places))
        return [(self.labels[h % len(self.labels)], h % 1000 / 1000) for h in found]


@register("hash-spans")
@dataclass
class HashSpans:
    """Words of four letters or more by their md5, and some with the next word, so that candidates overlap and scores are equal."""

    every: int = 5

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        out = []
        for text in texts:
            words = [m for m in WORD.finditer(text) if len(m[0]) >= 4]
            own = []
            for k, m in enumerate(words):
                h = number("s|" + m[0].lower())
                if h % self.every == 0:
                    own.append((m.start(), m.end(), LABELS[h % 13], h % 20 / 20))
                    if h % 2 == 0 and k + 1 < len(words):
                        own.append((m.start(), words[k + 1].end(), LABELS[(h + 1) % 13], h % 7 / 7))
            out.append(own)
        return out


@register("hash-chat")
@dataclass
class HashChat:
    """Answers with the words that HashTagger tags and their labels, in a form that the text's length tells."""

    every: int = 7

    def chat_completion(self, system: str, user: str, temperature: float = 1.0) -> str:
        found = dict.fromkeys((user[s:e].lower(), tag[2:]) for s, e, tag, _ in HashTagger(self.every).tag(user))
        forms = (
            lambda: json.dumps([{"term": t, "label": x} for t, x in found]), lambda: "\n".join(f"- {t}: {x}" for t, x in found),
            lambda: "Entities: " + json.dumps([{"term": t, "label": x} for t, x in found])[:-1] + ", {\"term\": \"cut o", lambda: "".join(f"{t}: {x.upper()}, " for t, x in found),
        )
        return forms[len(user) % 4]() if found else "[]"


@register("letters")
@dataclass
class Letters:
    """A vector of letter counts."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


@register("echo")
@dataclass
class Echo:
    """Answers with the user's message."""

    def chat_completion(self, system: str, user: str, temperature: float = 1.0) -> str:
        return user


def all_of(provider, one: str, texts: list, *more) -> list:
    """What a provider gives for each text: from its method for lists (`<one>_all`), else a call each. more: a list each, of the other arguments."""
    many = getattr(provider, f"{one.removesuffix('_completion')}_all", None)
    if many:
        return list(many(texts, *more))
    return [getattr(provider, one)(*x) for x in zip(texts, *more)]


def tagged(texts: DataFrame, tagger: Tagger) -> DataFrame:
    """paper_id, location, i, s, e, tag, score of the non-empty sections."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = all_of(tagger, "tag", batch.text.tolist())
            rows = [(p, l, i, s, e, tag, score) for p, l, own in zip(batch.paper_id, batch.location, said) for i, (s, e, tag, score) in enumerate(own)]
            yield pd.DataFrame(rows, columns=["paper_id", "location", "i", "s", "e", "tag", "score"])

    return texts.filter("text <> ''").select("paper_id", "location", "text").mapInPandas(run, "paper_id string, location string, i int, s int, e int, tag string, score double")


def flat(candidates: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping candidates the best by score, ties to the first start, then the shorter, then the label: greedy, as each kept one bars all that overlap it."""
    starts: list[int] = []
    kept: list[tuple[int, int, str, float]] = []
    for x in sorted(candidates, key=lambda x: (-x[3], x[0], x[1], x[2])):
        k = bisect.bisect_left(starts, x[0])
        if (k == 0 or kept[k - 1][1] <= x[0]) and (k == len(kept) or x[1] <= kept[k][0]):
            starts.insert(k, x[0])
            kept.insert(k, x)
    return kept


def extract_spans(texts: DataFrame, provider: Spans, threshold: float = 0.5, overlapping: bool = False) -> DataFrame:
    """paper_id, location, start_idx, end_idx (inclusive), label, confscore, text_span of candidates with a score of `threshold` or more.

    Of overlapping ones the best stays, unless `overlapping`. Texts reach the provider in lists of a batch; empty ones don't.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, l, t, own in zip(batch.paper_id, batch.location, batch.text, provider.spans(batch.text.tolist())):
                some = [x for x in own if x[3] >= threshold]
                rows += [(p, l, s, e - 1, label, score, t[s:e]) for s, e, label, score in (sorted(some) if overlapping else flat(some))]
            yield pd.DataFrame(rows, columns=["paper_id", "location", "start_idx", "end_idx", "label", "confscore", "text_span"])

    return texts.filter("text <> ''").select("paper_id", "location", "text").mapInPandas(run, "paper_id string, location string, start_idx int, end_idx int, label string, confscore double, text_span string")


def flattened(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The same choice on rows: by, start_idx, end_idx (inclusive), label, confscore; other columns go."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("start_idx", "end_idx", "label", "confscore"))))
        kept = flat([(s, e + 1, label, score) for s, e, label, score in rows if score is not None])
        own = [table.column(c)[:1].to_pylist() * len(kept) for c in by]
        made = [*own, *([x[0] for x in kept], [x[1] - 1 for x in kept], [x[2] for x in kept], [x[3] for x in kept])]
        return pa.table([pa.array(x, table.schema.field(c).type) for x, c in zip(made, names)], names)

    names = [*by, "start_idx", "end_idx", "label", "confscore"]
    some = candidates.select(*names)
    return some.groupBy(*by).applyInArrow(run, some.schema)


def embedded(texts: DataFrame, text: str, provider: Embedder) -> DataFrame:
    """texts with vector; nulls get none."""

    @F.pandas_udf("array<double>")
    def run(said: pd.Series) -> pd.Series:
        real = said.notna()
        out = pd.Series([None] * len(said), dtype=object)
        out[real] = pd.Series(provider.embed(said[real].tolist()), index=said.index[real], dtype=object)
        return out

    return texts.withColumn("vector", run(F.col(text)))


def extract_terms(texts: DataFrame, tagger: Tagger) -> DataFrame:
    """Spans of the tags, labels dropped, with the text that they cover."""
    plain = tagged(texts, tagger).withColumn("tag", F.substring("tag", 1, 1))
    return spans.span_text(spans.merged_tags(plain), texts)


def extract_entities(texts: DataFrame, tagger: Tagger) -> DataFrame:
    return spans.span_text(spans.merged_tags(tagged(texts, tagger), typed=True), texts)


def judged(df: DataFrame, text: str, classifier: Classifier, allowed: str | None = None) -> DataFrame:
    """df with verdict: struct(label, confscore)."""

    @F.pandas_udf("label string, confscore double")
    def run(seen: pd.Series, choices: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(all_of(classifier, "classify", seen.tolist(), [None if c is None else list(c) for c in choices]), columns=["label", "confscore"])

    return df.withColumn("verdict", run(F.col(text), F.col(allowed) if allowed else F.lit(None).cast("array<string>")))


def classify_terms(entities: DataFrame, texts: DataFrame, classifier: Classifier) -> DataFrame:
    """label and confscore of each entity from its marked text.

    A classifier that has `classify_places` is given a section's text and the places of its entities instead, as no marked text need be made then.
    """
    if hasattr(classifier, "classify_places"):
        return spans.beside_texts(entities.drop("label"), texts, classifier.classify_places, "label string, confscore double")
    seen = entities.drop("label").join(texts, ["paper_id", "location"]).withColumn("seen", mark_entity(F.col("text"), F.col("start_idx"), F.col("end_idx")))
    return judged(seen, "seen", classifier).select("*", "verdict.label", "verdict.confscore").drop("verdict", "seen", "text")


def marked_pairs(entities: DataFrame, texts: DataFrame, paired: Callable, window: int | None) -> DataFrame:
    """The pairs that `paired` makes of entities (with more columns), with `seen`: the text around both, marked."""
    if window is None:
        pairs = paired(entities, ()).join(texts, ["paper_id", "location"])
        return pairs.withColumn("seen", mark_pair(F.col("text"), *(F.col(f"{s}_{c}_idx") for s in ("subject", "object") for c in ("start", "end")))).drop("text")
    more = ("before", "text_span", "after")
    pairs = paired(spans.with_context(entities, texts, window), more)
    forward, backward = mark_pair_context(window, "subject", "object", "E1", "E2"), mark_pair_context(window, "object", "subject", "E2", "E1")
    return pairs.withColumn("seen", F.when(F.col("subject_start_idx") < F.col("object_start_idx"), forward).otherwise(backward)).drop(*[f"{s}_{c}" for s in relations.SIDES for c in more])


def extract_relations(entities: DataFrame, texts: DataFrame, valid: DataFrame, classifier: Classifier, window: int | None = None) -> DataFrame:
    """Predicates of all ordered pairs that pass the gates, NA dropped.

    window: the classifier sees so many characters around each span, which are cut once an
    entity; without it, it sees the whole text once a pair.
    """
    seen = marked_pairs(entities, texts, lambda x, more: relations.apart(relations.valid_pairs(x, valid, *more, both_ways=True)), window)
    seen = seen.withColumn("choices", F.array_append("predicates", F.lit("NA")))
    made = judged(seen, "seen", classifier, "choices").withColumns({"predicate": F.col("verdict.label"), "confscore": F.col("verdict.confscore")})
    return made.filter("predicate <> 'NA'").drop("verdict", "seen", "choices", "predicates")


def pair_relations(sections: DataFrame, rules: list[tuple[str, str, list[str]]], classifier: Classifier, window: int) -> DataFrame:
    """As `extract_relations` with a window, of sections (paper_id, location, text, lists start_idx, end_idx, label): no row and no text is made for a pair.

    rules: (head, tail, predicates). classifier: one with `classify_pairs`. Without uris, texts and labels of the ends.
    """
    labels = sorted({x for h, t, _ in rules for x in (h, t)})
    predicates = sorted({x for *_, p in rules for x in p})
    size = np.zeros((len(labels) + 1, len(labels) + 1), np.int64)
    numbers = np.zeros((*size.shape, max(len(p) for *_, p in rules)), np.int8)
    for h, t, p in rules:
        size[labels.index(h), labels.index(t)] = len(p)
        numbers[labels.index(h), labels.index(t), : len(p)] = [predicates.index(x) for x in p]
    place = {x: k for k, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, starts, ends, said = (batch.column(c)[k].as_py() for c in ("text", "start_idx", "end_idx", "label"))
                order = sorted(range(len(starts)), key=starts.__getitem__)
                s, e = np.array(starts)[order], np.array(ends)[order]
                own = np.array([place.get(said[x], len(labels)) for x in order])
                # Behind an entity are those that begin after its end; each of the two can be the subject.
                behind, n = np.searchsorted(s, e, "right"), len(s)
                tell, step = classifier.classify_pairs(text, list(zip(s.tolist(), e.tolist())), window), max(1, PAIRS_HELD // n)
                for a in range(0, n, step):
                    later = np.arange(n) >= behind[a : a + step, None]
                    for is_subject, rule in ((True, size), (False, size.T)):
                        i, j = np.nonzero(later & (rule[own[a : a + step]][:, own] > 0))
                        i += a
                        ends_ = (i, j) if is_subject else (j, i)
                        at = own[ends_[0]], own[ends_[1]]
                        which, score = classifier.choice(tell(i, j, is_subject), size[at] + 1)
                        kept = which < size[at]
                        if kept.any():
                            lists = (s[ends_[0][kept]], s[ends_[1][kept]], numbers[at][kept, which[kept]], score[kept])
                            packed = [pa.ListArray.from_arrays([0, len(x)], pa.array(x, t)) for x, t in zip(lists, (pa.int32(), pa.int32(), pa.int8(), pa.float64()))]
                            yield pa.record_batch([*batch.select(["paper_id", "location"]).slice(k, 1).columns, *packed], ["paper_id", "location", *PAIR_LISTS])

    some = sections.filter("text is not null and size(start_idx) > 1").select("paper_id", "location", "text", "start_idx", "end_idx", "label")
    made = some.mapInArrow(run, "paper_id string, location string, subject_start_idx array<int>, object_start_idx array<int>, predicate array<tinyint>, confscore array<double>")
    each = made.select("paper_id", "location", F.explode(F.arrays_zip(*PAIR_LISTS)).alias("x"))
    name = F.element_at(F.array(*map(F.lit, predicates)), F.col("x.predicate").cast("int") + 1)
    return each.select("paper_id", "location", "x.subject_start_idx", "x.object_start_idx", name.alias("predicate"), "x.confscore")


#: Pairs that are looked at at once, of which about a tenth are relations: these leave Python as a row.
PAIRS_HELD = 65_536
PAIR_LISTS = ["subject_start_idx", "object_start_idx", "predicate", "confscore"]


def answered(prompts: DataFrame, chat: Chat, temperature: float = 1.0) -> DataFrame:
    """prompts (with system, user) with response and failure: a failed call gives no response but its reason, and its row stays.

    Where a list fails (`chat_all`), its prompts are asked one by one, so that one of them does not take the others with it.
    """

    def one(system: str, user: str) -> tuple[str | None, str | None]:
        try:
            return chat.chat_completion(system, user, temperature), None
        except Exception as x:  # noqa: BLE001  a provider may raise anything
            return None, f"{type(x).__name__}: {x}"

    @F.pandas_udf("response string, failure string")
    def run(system: pd.Series, user: pd.Series) -> pd.DataFrame:
        try:
            many = chat.chat_all if hasattr(chat, "chat_all") else None
            rows = [(x, None) for x in many(system.tolist(), user.tolist(), [temperature] * len(user))] if many else None
        except Exception:  # noqa: BLE001
            rows = None
        return pd.DataFrame(rows or [one(s, u) for s, u in zip(system, user)], columns=["response", "failure"], dtype=object)

    return prompts.withColumn("_said", run("system", "user")).select("*", "_said.response", "_said.failure").drop("_said")


#: Fixed value: the score of what a chat model finds, which tells none.
NO_SCORE = -1.0


def asked(texts: DataFrame, chat: Chat, system: str, template: str, temperature: float = 1.0) -> DataFrame:
    """texts (any columns, text) with response and failure of the template filled with text; empty texts are not asked."""
    prompts = texts.filter("text <> ''").withColumns({"system": F.lit(system), "user": prompt(template, F.col("text"))})
    return answered(prompts, chat, temperature).drop("system", "user")


def llm_entities(texts: DataFrame, chat: Chat, system: str, template: str, temperature: float = 1.0, labels: list[str] = LABELS) -> DataFrame:
    """paper_id, location, start_idx, end_idx, text_span, label, confscore: what answers name, at all its places in its section.

    Answers are read by `functions.responses` and anchored in one pass a section; a pair named twice counts once.
    """
    said = asked(texts.select("paper_id", "location", "text"), chat, system, template, temperature)
    return anchored_entities(said.select("paper_id", "location", "response"), texts, labels)


def anchored_entities(responses: DataFrame, texts: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """The entities of responses (paper_id, location, response)."""
    named = responses.select("paper_id", "location", F.explode(term_label_pairs(F.col("response"))).alias("x")).select("paper_id", "location", "x.term", known_label(F.col("x.label"), labels).alias("label")).distinct()
    return anchored(named, texts).drop("term").withColumn("confscore", F.lit(NO_SCORE))


def llm_labels(entities: DataFrame, texts: DataFrame, chat: Chat, system: str, template: str, temperature: float = 1.0, labels: list[str] = LABELS) -> DataFrame:
    """entities with label and confscore from answers about their marked text."""
    seen = entities.drop("label").join(texts, ["paper_id", "location"]).withColumn("text", mark_entity(F.col("text"), F.col("start_idx"), F.col("end_idx")))
    said = asked(seen, chat, system, template, temperature)
    return said.withColumns({"label": parse_label(F.col("response"), labels), "confscore": F.lit(NO_SCORE)}).drop("text", "response", "failure")


def llm_relations(entities: DataFrame, texts: DataFrame, valid: DataFrame, chat: Chat, system: str, template: str, temperature: float = 1.0, across: bool = False, window: int | None = None) -> DataFrame:
    """Relations that answers about marked pairs tell; NA goes, and so does what cannot hold between labels only before it is asked.

    Pairs are those of one section whose labels can be related, the subject before the object in the list; across:
    of the whole paper, seen in title + ' ' + abstract (texts: of both sections). window: as in `extract_relations`.
    Places are those in their sections: subject_location and object_location tell which.
    """
    own = entities.withColumn("section", F.col("location"))
    if across:
        both = texts.groupBy("paper_id").agg(F.max(F.when(F.col("location") == "title", F.col("text"))).alias("title"), F.max(F.when(F.col("location") == "abstract", F.col("text"))).alias("abstract")).fillna("")
        own = spans.shifted(own, both).withColumn("location", F.lit("all"))
        texts = both.select("paper_id", F.lit("all").alias("location"), F.concat("title", F.lit(" "), "abstract").alias("text"))
    pairs = marked_pairs(own, texts, lambda x, more: relations.valid_pairs(x, valid, "section", *more), window)
    said = asked(pairs.withColumnRenamed("seen", "text"), chat, system, template, temperature)
    made = said.withColumns({"predicate": parse_label(F.col("response"), PREDICATES), "confscore": F.lit(NO_SCORE)}).filter("predicate <> 'NA'")
    made = made.withColumnsRenamed({f"{s}_section": f"{s}_location" for s in relations.SIDES}).drop("text", "response", "failure", "predicates", "location")
    if across:
        for s in relations.SIDES:
            by = F.when(F.col(f"{s}_location") == "abstract", F.col("_by")).otherwise(0)
            made = made.join(both.select("paper_id", (F.length("title") + 1).alias("_by")), "paper_id").withColumns({f"{s}_{c}_idx": F.col(f"{s}_{c}_idx") - by for c in ("start", "end")}).drop("_by")
    return made


BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")


def terms_of(response: str | None) -> list[str]:
    """The terms in a response: a JSON array anywhere, else bullets, else lines, else commas."""
    text = (response or "").strip()
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\[", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        return [str(x["term"] if isinstance(x, dict) and "term" in x else x).strip() for x in found if not isinstance(x, list)]
    lines = [x for x in text.splitlines() if x.strip()]
    bullets = [BULLET.sub("", x).strip() for x in lines if BULLET.match(x)]
    parts = bullets or (lines if len(lines) > 1 else text.split(","))
    return [x.strip().strip("\"'") for x in parts if x.strip()]


def parsed_terms(responses: DataFrame) -> DataFrame:
    """terms: what each response lists."""

    @F.pandas_udf("array<string>")
    def run(said: pd.Series) -> pd.Series:
        return said.map(terms_of)

    return responses.withColumn("terms", run("response"))
