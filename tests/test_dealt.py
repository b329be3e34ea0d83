"""Collections of papers are dealt once, as texts: what is derived from them stays where its paper is."""

import re

import pytest

from annolake.operators import scoring
from annolake.operators.segment import BLOCK, long_words, tokenise
from annolake.plans import evaluation, linking_relations, models, registry, text  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ens_re_weighted", "ens_re_mixed", "ens_ner_union", "relation_lists", "bio_merge", "negative_spans", "docred_nested", "stub_re", "ft_re", "mention_relations"])
def test_only_texts_are_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(paper_id#\d+, \d+\), REPARTITION_BY_NUM", plan)
    assert dealt and len(re.findall(r"\bExchange ", plan)) == len(dealt)
    assert "InMemoryTableScan" not in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"  # the given session stays as it is


def test_counted_reads_each_side_once(spark):
    own = spark.createDataFrame([(0, "p", "a"), (0, "p", "a"), (1, "p", "b"), (1, "p", None)], "m int, k string, label string")
    gold = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "c"), ("p", None)], "k string, label string")
    made = scoring.counted(own, gold, ["k", "label"], ["label"], ["m"])
    rows = {(r["m"], r["label"]): (r["annotated"], r["predicted"], r["tp"]) for r in made.collect()}
    assert rows == {(0, "a"): (2, 2, 2), (0, "c"): (1, 0, 0), (0, None): (1, 0, 0), (1, "a"): (2, 0, 0), (1, "b"): (0, 1, 0), (1, "c"): (1, 0, 0), (1, None): (1, 1, 0)}


def test_long_words_are_those_of_all_tokens(spark):
    said = [" ".join(["ab", "word", "x1", "étés", "\U0001d4d0bcd", "."] * (BLOCK * 2)), "...", "last", "", "short a b", "end words ", "." * 50_000, "ab, " * 20_000 + "done"]
    texts = spark.createDataFrame([(str(k), "title", t) for k, t in enumerate(said)], "paper_id string, location string, text string")
    own = {}
    for r in tokenise(texts, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\s+").filter(r"length(tok) >= 4 and tok rlike '^[\\p{L}\\p{N}_]+$'").orderBy("paper_id", "i").collect():
        assert said[int(r["paper_id"])][r["s"] : r["e"]] == r["tok"]
        own.setdefault(r["paper_id"], []).append((r["tok"], r["s"], r["e"]))
    known = {(p, t, s, e, x[k + 1][2] if k + 1 < len(x) else None) for p, x in own.items() for k, (t, s, e) in enumerate(x)}
    assert {tuple(r) for r in long_words(texts, 4).select("paper_id", "tok", "s", "e", "ne").collect()} == known
