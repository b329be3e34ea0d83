"""Pieces as a list a section are those of rows a piece, and nothing is shuffled or read twice for them."""

import pytest
from pyspark.sql import functions as F

from annolake.functions import subwords
from annolake.plans import evaluation, linking_relations, models, registry, text  # noqa: F401  they register their queries

TEXTS = [("1", "title", "Playing  games, étés!"), ("1", "abstract", ""), ("2", "title", "\U0001d4d0 unknownword play."), ("2", "abstract", None), ("3", "title", "##ing </w> " + "game " * 300)]


@pytest.mark.parametrize("marks", [{"continues": "##"}, {"continues": "", "ends": "</w>"}])
def test_lists_are_those_of_rows(spark, monkeypatch, marks):
    monkeypatch.setattr(subwords, "ROWS", 50)
    pieces = ["play", "##ing", "ing</w>", "game", "##s", "s</w>", "game</w>", "play</w>", ",", ",</w>", "!", "#", "#</w>", "ing", "w", "w</w>", "<", "<</w>", ".", ".</w>"]
    known = subwords.Vocabulary({p: k for k, p in enumerate(pieces)}, lower=True, **marks)
    texts = spark.createDataFrame(TEXTS, "paper_id string, location string, text string").repartition(1)
    lists, rows = subwords.piece_lists(texts, known), subwords.pieces(texts, known)
    each = lists.select("paper_id", "location", F.posexplode(F.arrays_zip("piece", "id", "word", "s", "e")).alias("i", "x")).select("paper_id", "location", "i", "x.*")
    assert sorted(map(repr, each.collect())) == sorted(map(repr, rows.collect()))
    text = {(r["paper_id"], r["location"]): r["text"] for r in subwords.joined(rows, **marks).collect()}
    assert {(r["paper_id"], r["location"]): r["text"] for r in lists.select("paper_id", "location", subwords.joined_list(**marks).alias("text")).collect()} == text
    assert len(text) == 3


def test_pieces_are_not_shuffled(spark):
    plan = registry.QUERIES["subword_pieces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
