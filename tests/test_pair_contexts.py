"""Relations of whole sections against those of marked texts, a text a pair."""

import pytest
from pyspark.sql import functions as F

from annolake import providers
from annolake.plans import registry, text  # noqa: F401  they register their queries
from annolake.schema import LABELS, PREDICATES, VALID_RELATIONS, valid_relations

SAID = " ".join(f"w{k} étés \U0001d4d0bcd{k} plain." for k in range(40))


@pytest.mark.parametrize("window, held", [(5, 4096), (20, 3), (200, 4096)])
def test_relations_are_those_of_marked_texts(spark, monkeypatch, window, held):
    monkeypatch.setattr(providers, "PAIRS_HELD", held)
    texts = spark.createDataFrame([("1", "title", SAID), ("1", "abstract", SAID[:300]), ("2", "title", "")], "paper_id string, location string, text string")
    rows = [("1", where, a, a + 2 + k % 9, (LABELS + ["other"])[k % 14], "C1", k) for where, most in (("title", len(SAID)), ("abstract", 300)) for k, a in enumerate(range(0, most - 12, 13))]
    rows += [("1", "title", 13, 40, "drug", "C2", 900), ("1", "title", 20, 20, "human", "C2", 901)]
    entities = spark.createDataFrame(rows, "paper_id string, location string, start_idx int, end_idx int, label string, uri string, ord int")
    lists = entities.groupBy("paper_id", "location").agg(F.collect_list(F.struct("start_idx", "end_idx", "label")).alias("x")).select("paper_id", "location", *[F.col("x")[c].alias(c) for c in ("start_idx", "end_idx", "label")])
    kind = providers.HashClassifier(PREDICATES)
    order = ["paper_id", "location", "subject_start_idx", "object_start_idx", "predicate", "confscore"]
    known = providers.extract_relations(entities, texts, valid_relations(spark), kind, window).select(order)
    made = providers.pair_relations(texts.join(lists, ["paper_id", "location"]), [(h, t, sorted(p)) for h, t, p in VALID_RELATIONS], kind, window)
    rows = sorted(made.collect())
    assert len(rows) > 500 and rows == sorted(known.collect())


def test_no_text_for_each_pair(spark):
    plan = registry.QUERIES["stub_re"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "[/E1]" not in plan and "ArrowEvalPython" not in plan and plan.count("Join") == 1
