"""Marked texts are digested and classified from places: a section's text meets its entities once."""

import hashlib

import pytest
from pyspark.sql import functions as F

from annolake import providers
from annolake.functions.digests import marked_digests
from annolake.functions.text import mark_entity
from annolake.operators import finetune, spans
from annolake.plans import evaluation, linking_relations, models, registry, text  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.001"
SAID = [("1", "title", "plain words here"), ("1", "abstract", "\u00e9t\u00e9s \U0001d4d0bcd \u20ac x"), ("2", "title", ""), (None, "title", "no paper"), ("3", "title", "one"), ("3", "title", "two")]
ENTITIES = [("1", "title", 6, 10, "b"), ("1", "title", 0, 4, "a"), ("1", "title", 0, 15, "a"), ("1", "abstract", 0, 4, "a"), ("1", "abstract", 6, 9, "b"), ("1", "abstract", 11, 13, ""), ("9", "title", 0, 1, "a"), (None, "title", 0, 1, "a"), ("3", "title", 0, 2, "c")]


@pytest.fixture()
def tables(spark):
    texts = spark.createDataFrame(SAID, "paper_id string, location string, text string")
    return texts, spark.createDataFrame([(*x, k) for k, x in enumerate(ENTITIES)], "paper_id string, location string, start_idx int, end_idx int, label string, ord int")


def test_digests_are_those_of_marked_texts(tables):
    texts, entities = tables
    known = {(p, w, s, e, hashlib.md5(f"<{t[:s]}[E1]{t[s:e + 1]}[/E1]{t[e + 1:]}>".encode()).hexdigest()) for p, w, s, e, _ in ENTITIES for q, v, t in SAID if p and (p, w) == (q, v)}
    made = spans.beside_texts(entities, texts, lambda text, places: [(x.hex(),) for x in marked_digests(text, places, "<", ">")], "marked string")
    assert {(r["paper_id"], r["location"], r["start_idx"], r["end_idx"], r["marked"]) for r in made.collect()} == known
    assert made.columns == [*entities.columns, "marked"]


def test_many_batches_of_one_section(spark):
    session = registry.planned(spark)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    texts = session.createDataFrame([(str(k), "title", f"{k} " + "\u00e9 word " * 30) for k in range(5)], "paper_id string, location string, text string")
    entities = session.range(200).selectExpr("cast(id % 5 as string) as paper_id", "'title' as location", "cast(id as int) as start_idx", "cast(id + 3 as int) as end_idx")
    made = spans.beside_texts(entities, texts, lambda text, places: [(x.hex(),) for x in marked_digests(text, places)], "marked string")
    plain = entities.join(texts, ["paper_id", "location"]).select(*entities.columns, F.md5(mark_entity(F.col("text"), F.col("start_idx"), F.col("end_idx"))).alias("marked"))
    assert sorted(made.collect()) == sorted(plain.collect())


def test_places_are_classified_as_marked_texts_are(tables):
    texts, entities = tables

    class Plain:
        def classify(self, text, allowed=None):
            return providers.HashClassifier().classify(text, allowed)

    order = ["paper_id", "location", "start_idx", "end_idx", "ord", "label", "confscore"]
    own, known = (providers.classify_terms(entities, texts, c).select(order).collect() for c in (providers.HashClassifier(), Plain()))
    assert sorted(own) == sorted(known) and len(own) == 8


@pytest.mark.parametrize("template", ["Say {x}: {text}", "{text} and {text}", "none"])
def test_digests_of_label_examples(tables, template):
    texts, entities = tables
    whole = finetune.label_examples(texts, entities, "s", template).withColumn("user", F.md5("user"))
    assert sorted(finetune.label_examples(texts, entities, "s", template, digest=True).collect()) == sorted(whole.collect())


@pytest.mark.parametrize("name", ["mark_entity_text", "stub_tc", "ft_tc"])
def test_no_text_for_each_entity(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "[/E1]" not in plan and "Join" not in plan
