"""Entities and relations are drawn in numpy, many at once, as the SQL draws each of them."""

import numpy as np
import pyarrow as pa
import pytest

from annolake.functions.digests import BLOCK, head, numbered_heads, prefixes, text_heads
from annolake.operators.segment import long_words
from annolake.plans import evaluation, linking_relations, models, registry, text  # noqa: F401  they register their queries
from annolake.sources import drawn

SF = "/root/testdata/sf0.001"
TEXTS = ["", "short a b", "one word", "étés \U0001d4d0bcd x1 under_score end", "...", "last\nword", "ΣΑΣ ΟΔΟΣ İstanbul", "² ½¼¾x ٣٤٥٦", "word " * 3000]


@pytest.mark.parametrize("name", ["metric_guards", "non_na_relations", "ens_re_weighted", "eval_re_micro", "merge_all_pairs"])
def test_no_digest_a_row_in_the_plan(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "md5(" not in plan and "regexp_extract_all" not in plan


def test_heads_of_numbered_texts():
    texts = ["r|7|title|", "q|0|", "", "x" * 45]
    numbers = np.array([0, 9, 10, 99, 100, 12345, 2**31 - 1] * (BLOCK // 2 + 3))
    which = np.arange(len(numbers)) % len(texts)
    made = numbered_heads(*prefixes(texts), which, numbers)
    some = [*range(60), *range(BLOCK - 30, BLOCK + 30), len(numbers) - 1]
    assert [int(made[k]) for k in some] == [head(f"{texts[which[k]]}{numbers[k]}") for k in some]
    both = numbered_heads(*prefixes(["r|7|"]), np.zeros(3, int), np.array([5, 50, 500]), ((0, "p"), (2, "8")))
    assert both.tolist() == [[head(f"p|7|{n}") for n in (5, 50, 500)], [head(f"p|8|{n}") for n in (5, 50, 500)]]
    with pytest.raises(ValueError, match="55 bytes"):
        numbered_heads(*prefixes(["x" * 50]), np.zeros(1, int), np.array([10**6]))


def test_heads_of_any_texts():
    texts = ["g|étés", "", "g|" + "x" * 53, "g|" + "x" * 54, "g|" + "\U0001d4d0" * 30, "g|x"] + [f"g|{k}" for k in range(BLOCK)]
    assert text_heads(texts)[0].tolist() == [head(x) for x in texts]
    own = [x or "g" for x in texts]
    assert text_heads(own, ("g", "n")).tolist() == [[head(c + x[1:]) for x in own] for c in "gn"]
    assert text_heads([]).shape == (1, 0)


def test_python_is_given_few_texts_at_once(spark):
    session = registry.planned(spark)
    texts = session.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 2000) as text")
    sizes = [r["n"] for r in texts.mapInArrow(lambda parts: (pa.record_batch([pa.array([x.nbytes])], ["n"]) for x in parts), "n long").collect()]
    assert sum(sizes) > 25_000_000 and max(sizes) < 8_000_000


def test_words_are_not_kept_between_texts():
    before = set(vars(drawn))
    for k in range(3):
        drawn.Words([" ".join(f"word{k}x{j}" for j in range(2000))])
    assert set(vars(drawn)) == before and not [x for x in (*vars(drawn).values(), *vars(drawn.Words).values()) if isinstance(x, dict) and any("x1999" in str(y) for y in x)]


def test_counts_by_model_deal_no_papers(spark):
    plan = registry.QUERIES["metric_guards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan


def test_words_are_those_of_the_operator(spark):
    made = drawn.Words(TEXTS)
    own = {(str(k), TEXTS[k][s:e], s, e, None if ne < 0 else ne) for k, s, e, ne in zip(*(x.tolist() for x in (made.section, made.s, made.e, made.ne)))}
    rows = spark.createDataFrame([(str(k), "title", t) for k, t in enumerate(TEXTS)], "paper_id string, location string, text string")
    assert own == {tuple(r) for r in long_words(rows, 4).select("paper_id", "tok", "s", "e", "ne").collect()}


def test_null_and_empty_papers_draw_nothing():
    part = pa.record_batch([pa.array([None, "2", "3"]), pa.array([None, "", "a b c"]), pa.array(["word other entity matter", None, ""])], ["paper_id", "title", "abstract"])
    for draw in (drawn.pred, drawn.gold_relations, drawn.pred_relations):
        assert sum(x.num_rows for x in draw(iter([part]))) == 0
    assert all(p is None for x in drawn.gold(iter([part])) for p in x.column(0).to_pylist())


def test_parts_of_pairs_are_whole(monkeypatch):
    text = " ".join(f"word{k % 97}" for k in range(900))
    part = pa.record_batch([pa.array(["1", "22"]), pa.array(["Title words matter here", text]), pa.array([text, "short"])], ["paper_id", "title", "abstract"])
    flat = lambda: sorted((p, w, *x) for b in drawn.gold_relations(iter([part])) for p, w, *lists in zip(*b.to_pydict().values()) for x in zip(*lists))
    whole = flat()
    for name in ("PAIRS", "HELD"):
        monkeypatch.setattr(drawn, name, 50)
    assert whole and flat() == whole


@pytest.mark.parametrize("name", ["ner_score", "nerd_score", "mre_score"])
def test_scores_gather_no_lists_by_key(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # One list, of the few counts by model and label, is left.
    assert len({x for x in plan.split() if x.startswith("collect_list(")}) <= 1 and "FullOuter" not in plan
    assert plan.count("Exchange SinglePartition") <= 1


@pytest.mark.parametrize("models", [(0,), (1, 2)])
def test_only_asked_models_are_drawn(monkeypatch, models):
    text = " ".join(f"word{k % 97}" for k in range(500))
    part = pa.record_batch([pa.array(["1"]), pa.array([text]), pa.array([text])], ["paper_id", "title", "abstract"])

    def rows(made, asked):
        each = [(w, x) for b in made for _, w, *lists in zip(*b.to_pydict().values()) for x in zip(*lists)]
        return sorted((m, w, x[:4], said) for w, x in each for m, said in zip(asked, x[4:]) if said >= 0)

    whole = rows(drawn.pred_relations(iter([part])), drawn.MODELS)
    calls = []
    plain = drawn.numbered_heads
    monkeypatch.setattr(drawn, "numbered_heads", lambda *x: calls.append(len(x[4]) if len(x) > 4 else 1) or plain(*x))
    assert rows(drawn.pred_relations(iter([part]), models), models) == [x for x in whole if x[0] in models] != []
    assert max(calls) == len(models)
