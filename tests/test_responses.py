"""Free-form answers: the six forms, broken JSON, anchors, chat loops, span providers."""

import json
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from annolake import providers
from annolake.functions import responses
from annolake.operators import anchors
from annolake.schema import LABELS, valid_relations

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests
TEXT = "paper_id string, location string, text string"


@pytest.mark.parametrize(("said", "stage", "pairs"), [
    ('Sure: [{"term": "E. coli", "label": "bacteria"}, {"term": " gut ", "label": "x"}] done', "objects", [("E. coli", "bacteria"), ("gut", "x")]),
    ('[{"term": "a"}, {"label": "gene"}, {"term": "b", "label": null, "more": [1]}]', "cut", [("a", "NA"), ("b", "NA")]),  # the inner ] ends the array: what is whole counts
    ('[{"term": "a"}, {"label": "gene"}, {"term": 7, "label": "drug"}]', "objects", [("a", "NA"), ("7", "drug")]),
    ('[{"term": "a", "label": "gene"},\n{"term": "b", "label": "food"},\n{"term": "c", "lab', "cut", [("a", "gene"), ("b", "food")]),
    ('[{"term": "a [x]", "label": "gene"}]', "cut", [("a [x]", "gene")]),
    ('["one", "two", ""]', "strings", [("one", "NA"), ("two", "NA")]),
    ("Found:\n- one: gene\n* two | food\n3) three - drug\n4. four", "bullets", [("one", "gene"), ("two", "food"), ("three", "drug"), ("four", "NA")]),
    ("one | gene\n\n two: food \r\nthree", "lines", [("one", "gene"), ("two", "food"), ("three", "NA")]),
    ("one: gene, two: food,, three", "commas", [("one", "gene"), ("two", "food"), ("three", "NA")]),
    ("  just this: gene ", "whole", [("just this: gene", "NA")]),
    ("[not json], but: gene", "commas", [("[not json]", "NA"), ("but", "gene")]),
    ("{'term': 'a', 'label': 'gene'}", "commas", [("{'term'", "'a'"), ("'label'", "'gene'}")]),  # no JSON
    ("", None, []), ("  \n ", None, []), (None, None, []), ("[]", "whole", [("[]", "NA")]),
])
def test_forms_of_answers(spark, said, stage, pairs):
    df = spark.createDataFrame([(said,)], "r string")
    read = responses.stages(F.col("r"))
    row = df.select(responses.term_label_pairs(F.col("r")).alias("pairs"), *(c.isNotNull().alias(n) for n, c in read.items())).first()
    assert [tuple(x) for x in row["pairs"]] == pairs
    assert next((n for n in read if row[n]), None) == stage


def test_labels_of_the_scheme(spark):
    df = spark.createDataFrame([(" GENE ",), ("genes",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(responses.known_label(F.col("x"))).collect()] == ["gene", "NA", "NA", "NA"]


@pytest.mark.parametrize("seed", range(4))
def test_places_against_patterns(seed):
    rng = random.Random(seed)
    letters = "aAbBé İß."
    text = "".join(rng.choice(letters) for _ in range(300))
    terms = ["".join(rng.choice("abé.ß") for _ in range(rng.randint(1, 4))) for _ in range(30)] + ["", "a", "A"]
    want = sorted((k, m.start(), m.end()) for k, t in enumerate(terms) if t for m in re.finditer(re.escape(t.lower()), anchors.folded(text)))
    assert anchors.places(text, terms) == want and len(want) > 50
    assert anchors.places("", ["a"]) == anchors.places("a", []) == []


def test_anchored_rows_keep_their_columns(spark):
    terms = spark.createDataFrame([("p", "title", "gut", "a"), ("p", "title", "gut", "b"), ("p", "title", None, "c"), ("p", "title", "", "d"), ("p", "title", "none", "e"), ("q", "title", "x", "f")], "paper_id string, location string, term string, label string")
    texts = spark.createDataFrame([("p", "title", "Gut and gut"), ("q", "title", None)], TEXT)
    found = sorted((r["label"], r["start_idx"], r["end_idx"], r["text_span"]) for r in anchors.anchored(terms, texts).collect())
    assert found == [("a", 0, 2, "Gut"), ("a", 8, 10, "gut"), ("b", 0, 2, "Gut"), ("b", 8, 10, "gut")]


class Says:
    """Answers by what the user's text holds; fails on 'bad'."""

    def __init__(self, answer="[]", many=False):
        self.answer = answer
        if many:
            self.chat_all = lambda systems, users, temperatures: [self.chat_completion(*x) for x in zip(systems, users, temperatures)]

    def chat_completion(self, system, user, temperature=1.0):
        if "bad" in user:
            raise RuntimeError("no answer")
        return self.answer if isinstance(self.answer, str) else self.answer(user)


@pytest.mark.parametrize("many", [False, True])
def test_chat_entities_and_failures(spark, many):
    texts = spark.createDataFrame([("p", "title", "Gut bacteria and gut"), ("p", "abstract", ""), ("q", "title", "bad text")], TEXT)
    chat = Says('[{"term": "gut", "label": "Anatomical location"}, {"term": "GUT", "label": "anatomical location"}, {"term": "absent", "label": "gene"}]', many)
    found = [tuple(r) for r in providers.llm_entities(texts, chat, "s", "{text}").select("paper_id", "start_idx", "end_idx", "text_span", "label", "confscore").collect()]
    label = "anatomical location" if "anatomical location" in LABELS else "NA"
    assert sorted(set(found)) == [("p", 0, 2, "Gut", label, -1.0), ("p", 17, 19, "gut", label, -1.0)]
    said = {r["paper_id"]: (r["response"] is None, r["failure"]) for r in providers.asked(texts, chat, "s", "{text}").collect()}
    assert said == {"p": (False, None), "q": (True, "RuntimeError: no answer")}


ENTITY = "paper_id string, location string, start_idx int, end_idx int, label string, ord int"


@pytest.mark.parametrize("window", [None, 30])
def test_chat_relations_within_and_across_sections(spark, window):
    heads = [(r["head"], r["tail"], r["predicates"][0]) for r in valid_relations(spark).collect()]
    head, tail, predicate = next(x for x in heads if x[0] != x[1])
    texts = spark.createDataFrame([("p", "title", "aa bb"), ("p", "abstract", "cc dd bad")], TEXT)
    entities = spark.createDataFrame([("p", "title", 0, 1, head, 0), ("p", "title", 3, 4, tail, 1), ("p", "abstract", 3, 4, tail, 2)], ENTITY)
    chat = Says(lambda user: f"{predicate.upper()}\nsince {user}" if "[E1]aa[/E1]" in user else "none")
    found = providers.llm_relations(entities, texts.filter("location = 'title'"), valid_relations(spark), chat, "s", "{text}", window=window).collect()
    assert [(r["subject_start_idx"], r["object_start_idx"], r["object_location"], r["predicate"]) for r in found] == [(0, 3, "title", predicate)]
    good = texts.withColumn("text", F.replace("text", F.lit("bad"), F.lit("ok")))
    found = providers.llm_relations(entities, good, valid_relations(spark), chat, "s", "{text}", across=True, window=window).collect()
    assert sorted((r["subject_start_idx"], r["subject_location"], r["object_start_idx"], r["object_end_idx"], r["object_location"], r["predicate"]) for r in found) == [(0, "title", 3, 4, "abstract", predicate), (0, "title", 3, 4, "title", predicate)]


def test_chat_labels(spark):
    texts = spark.createDataFrame([("p", "title", "aa bb")], TEXT)
    entities = spark.createDataFrame([("p", "title", 0, 1, "x", 0), ("p", "title", 3, 4, "x", 1)], ENTITY)
    found = providers.llm_labels(entities, texts, Says(lambda u: "Gene" if "[E1]aa" in u else "?"), "s", "Label: {text}")
    assert sorted((r["start_idx"], r["label"], r["confscore"]) for r in found.collect()) == [(0, "gene", -1.0), (3, "NA", -1.0)]


def brute_flat(rows):
    kept = []
    for x in sorted(rows, key=lambda x: (-x[3], x[0], x[1], x[2])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
            kept.append(x)
    return sorted(kept)


def test_greedy_choice_against_a_plain_walk(spark):
    rng = random.Random(1)
    sets = {f"p{k}": [(s, s + rng.randint(1, 9), rng.choice("ab"), rng.randint(0, 4) / 4) for s in (rng.randint(0, 60) for _ in range(40))] for k in range(20)}
    for rows in sets.values():
        assert sorted(providers.flat(rows)) == brute_flat(rows)
    df = spark.createDataFrame([(p, s, e - 1, l, c) for p, rows in sets.items() for s, e, l, c in rows], "paper_id string, start_idx int, end_idx int, label string, confscore double")
    found = sorted((r["paper_id"], r["start_idx"], r["end_idx"] + 1, r["label"], r["confscore"]) for r in providers.flattened(df, ["paper_id"]).collect())
    assert found == sorted((p, *x) for p, rows in sets.items() for x in brute_flat(rows))


def test_span_provider(spark):
    texts = spark.createDataFrame([("p", "title", "alpha beta gamma delta " * 20), ("p", "abstract", ""), ("q", "title", None)], TEXT)
    provider = providers.HashSpans(every=2)
    own = provider.spans(["alpha beta gamma delta " * 20])[0]
    for threshold in (0.0, 0.5):
        flat = providers.extract_spans(texts, provider, threshold).collect()
        assert sorted((r["start_idx"], r["end_idx"] + 1, r["label"], r["confscore"]) for r in flat) == brute_flat([x for x in own if x[3] >= threshold])
    every = providers.extract_spans(texts, provider, 0.0, overlapping=True)
    assert every.count() == len(own) and all(r["text_span"] == ("alpha beta gamma delta " * 20)[r["start_idx"] : r["end_idx"] + 1] for r in every.collect())
    assert json.dumps(own)


class Counted:
    """A provider that sees whole lists."""

    def classify_all(self, texts, allowed):
        return [(f"{len(texts)}", 0.5)] * len(texts)


def test_lists_reach_a_provider_whole(spark):
    df = spark.range(7).repartition(1).selectExpr("cast(id as string) x")
    assert {r["verdict"]["label"] for r in providers.judged(df, "x", Counted()).collect()} == {"7"}
