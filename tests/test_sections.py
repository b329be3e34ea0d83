"""Document records of whole sections against the operators on rows."""

import pytest
from pyspark.sql import functions as F

from annolake.operators import docred, segment, spans
from annolake.plans import registry, text  # noqa: F401  they register their queries
from annolake.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
SAID = ["One two-three. Four?) five ...six\x0bseven eight! ", "", " \n ", "...", "étés \U0001d4d0bcd. x", "word " * 60 + "end. " * 3, "a.b.c.d"]
PLACES = [(0, 2), (2, 8), (5, 20), (16, 16), (17, 22), (0, 40), (30, 33), (11, 12), (3, 3), (1, 500)]


@pytest.fixture()
def tables(spark):
    texts = spark.createDataFrame([(str(k), "title", t) for k, t in enumerate(SAID)], "paper_id string, location string, text string")
    rows = [(str(k), "title", a, b, "gene" if a % 2 else "drug", ("-1", "C1", "C2", "NA")[(a + b) % 4], n + 1) for k in range(len(SAID)) if k != 5 for n, (a, b) in enumerate(PLACES)]
    rows += [("5", "title", 5 * n, 5 * n + 3, "food", f"C{n % 3}", n + 1) for n in range(40)]
    entities = spark.createDataFrame(rows, "paper_id string, location string, start_idx int, end_idx int, label string, uri string, ord int")
    lists = entities.groupBy("paper_id", "location").agg(F.array_sort(F.collect_list(F.struct("ord", "start_idx", "end_idx", "label", "uri"))).alias("x")).select("paper_id", "location", *[F.col("x")[c].alias(c) for c in ("start_idx", "end_idx", "label", "uri", "ord")])
    return texts, entities, lists


def on_rows(texts, entities):
    tokens = docred.split_tokens(segment.tokenise(texts, fx.WORDPUNCT), entities)
    tokens = docred.sentence_tokens(tokens, docred.merged_sentences(segment.tokenise(texts, docred.SENTENCE), entities))
    placed = docred.placed_entities(entities, tokens)
    return placed, docred.nested(spans.span_text(placed, texts), tokens)


def test_lists_are_those_of_rows(tables):
    texts, entities, lists = tables
    placed, nested = on_rows(texts, entities)
    order = ["paper_id", "location", "ord", "sent_id", "first", "end"]
    known = sorted(placed.select(order).collect())
    assert len(known) > 40 and sorted(docred.placed_lists(texts.join(lists, ["paper_id", "location"])).select(order).collect()) == known
    made = docred.nested_lists(texts.join(lists, ["paper_id", "location"], "left"))
    assert made.schema.simpleString() == nested.schema.simpleString()
    assert {r["title"]: r for r in made.collect()} == {r["title"]: r for r in nested.collect()}
    some = docred.nested_lists(texts.join(lists.filter("paper_id = '5'"), ["paper_id", "location"], "left")).collect()
    assert {r["title"] for r in some if r["vertexSet"]} == {"5-title"} and len(some) == 5


def test_registered_records_are_those_of_rows(spark):
    big, _, _, tokens = text.document_records(registry.planned(spark), SF)
    known = docred.nested(fx.with_text(docred.placed_entities(big, tokens), big.sparkSession, SF), tokens)
    assert sorted(map(str, registry.QUERIES["docred_nested"](spark, SF).collect())) == sorted(map(str, known.collect()))


def test_papers_with_few_entities_go(tables):
    _, entities, lists = tables
    assert docred.enough_lists(lists, 11).select("paper_id").distinct().collect() == [("5",)]
    assert sorted(docred.enough_lists(lists).select("paper_id").collect()) == sorted(docred.with_enough_entities(entities).select("paper_id").distinct().collect())


@pytest.mark.parametrize("name", ["docred_entities", "docred_nested"])
def test_no_row_for_each_token(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate" in plan and plan.count("Generate explode") <= 2
