"""Votes, negatives, marked pairs and distinct tuples in numpy against the operators on rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.functions.digests import marked_pair_digests
from annolake.operators import ensemble, relations, scoring
from annolake.plans import evaluation, linking_relations, models, registry  # noqa: F401  they register their queries
from annolake.schema import PREDICATES

SF = "/root/testdata/sf0.001"


def test_predicates_are_numbered_in_order_of_their_names():
    assert PREDICATES == sorted(PREDICATES)


@pytest.mark.parametrize("method, weights", [("majority", [1.0, 1.0, 1.0]), ("weighted", [0.5, 0.25, 0.25]), ("weighted", [0.2, 0.5, 0.3]), ("union", [1.0, 1.0, 1.0]), ("intersect", [1.0, 1.0, 1.0])])
def test_aligned_votes_are_those_of_rows(spark, method, weights):
    rng = np.random.default_rng(2)
    values, scores = rng.integers(-1, 3, (3, 300)), rng.integers(0, 1000, (3, 300)) / 1000
    rows = [(m, str(n), "title", n, n, n + 9, n + 9, "gene", "drug", PREDICATES[values[m, n]], float(scores[m, n])) for m in range(3) for n in range(300) if values[m, n] >= 0]
    votes = spark.createDataFrame(rows, "m int, paper_id string, location string, subject_start_idx int, subject_end_idx int, object_start_idx int, object_end_idx int, subject_label string, object_label string, predicate string, confscore double")
    made = ensemble.relation_ensemble(votes, spark, method, weights).select(F.col("paper_id").cast("int"), "predicate", "score", F.round("confscore", 9)).collect()
    own = zip(*(x.tolist() for x in ensemble.aligned_votes(values, scores, method, weights)))
    assert sorted((n, PREDICATES[v], s, round(c, 9)) for n, v, s, c in own) == sorted(map(tuple, made))


def test_no_votes_no_items():
    assert [len(x) for x in ensemble.aligned_votes(np.zeros((3, 0), int), np.zeros((3, 0)), "union", [1.0] * 3)] == [0] * 4
    assert len(ensemble.aligned_votes(np.full((3, 4), -1), np.zeros((3, 4)), "majority", [1.0] * 3)[0]) == 0


def test_negative_places_are_those_of_rows(spark):
    rng = np.random.default_rng(3)
    paper, order, own = np.sort(rng.integers(0, 9, 400)), rng.integers(0, 40, 400), rng.random(400) < 0.3
    own[paper == 4] = False
    pairs = [(str(p), "title", k, 1000 + k, int(o)) for k, (p, o) in enumerate(zip(paper, order))]
    df = spark.createDataFrame(pairs, "paper_id string, location string, subject_start_idx int, object_start_idx int, h int")
    held = df.join(spark.createDataFrame([(k,) for k in np.flatnonzero(own).tolist()], "subject_start_idx int"), "subject_start_idx")
    for times in (1, 2):
        known = sorted(r["subject_start_idx"] for r in relations.negatives(df, held, times, F.col("h")).collect())
        assert known and sorted(relations.negative_places(paper, order, own, times).tolist()) == known
    assert len(relations.negative_places(np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))) == 0


def test_digests_of_marked_pairs():
    data = "étés \U0001d4d0bcd ".encode() * 30
    first = [(0, 4), (0, 4), (0, 4), (9, 12), (9, 12), (100, 110)]
    second = [(4, 5), (9, 12), (50, len(data)), (12, 12), (80, 90), (110, 130)]
    plain = [data[:a] + b"[E2]" + data[a:b] + b"[/E2]" + data[b:c] + b"[E1]" + data[c:d] + b"[/E1]" + data[d:] for (a, b), (c, d) in zip(first, second)]
    assert marked_pair_digests(data, first, second, (b"E2", b"E1")) == [hashlib.md5(x).hexdigest() for x in plain]


def test_tuple_counts_are_those_of_rows(spark):
    rng = np.random.default_rng(5)
    gold, said = rng.integers(0, 60, 50), [rng.integers(0, 60, 40), np.zeros(0, int), rng.integers(0, 90, 70)]
    rows = [(m, int(k), int(k) % 7) for m, own in enumerate(said) for k in set(own.tolist())]
    known = scoring.counted(spark.createDataFrame(rows, "m int, k int, label int"), spark.createDataFrame([(k, k % 7) for k in set(gold.tolist())], "k int, label int"), ["k", "label"], ["label"], ["m"])
    counts = spark.createDataFrame([(m >= 0, m if m >= 0 else None, *x) for m, *x in np.concatenate(scoring.tuple_counts(gold, said, lambda x: x % 7), 1).T.tolist()], "_said boolean, m int, label int, annotated long, predicted long, tp long")
    assert sorted(scoring.gridded(counts, ["m"], ["label"]).collect()) == sorted(known.select("m", "label", "annotated", "predicted", "tp").collect())


@pytest.mark.parametrize("name", ["ens_re_majority", "ens_re_weighted", "ens_re_union", "negatives_pairs", "mark_pair_text", "mark_pair_reversed", "mre_score", "ens_re_mixed"])
def test_pairs_meet_nothing_as_rows(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Sort " not in plan and "md5(" not in plan


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixed_votes_are_those_of_rows(spark, seed):
    """Pairs of two papers, a few texts for many places, so that some votes by texts have one place, some several and some none."""
    rng = np.random.default_rng(seed)
    texts = rng.integers(0, 30, 60)
    votes = [(m, n, int(texts[n]), bool(rng.random() < 0.5), int(rng.integers(0, 3)), int(rng.integers(0, 1000)) / 1000) for n in range(60) for m in range(3) if rng.random() < 0.7]
    fields = [*ensemble.PLACES, *ensemble.FIELDS]
    rows = []
    for k, (m, n, t, bare, v, c) in enumerate(votes):
        places = [None] * 6 if bare else [n, n + 1, "title", n + 50, n + 60, "title"]
        rows.append((m, f"p{t % 2}", k, *places, f"s{t}", "gene", None, f"o{t}", "drug", None, PREDICATES[v], c))
    kinds = ", ".join(f"{c} {'int' if c.endswith('idx') else 'string'}" for c in fields)
    df = spark.createDataFrame(rows, f"m int, paper_id string, ord int, {kinds}, predicate string, confscore double")
    known = ensemble.mixed_relation_ensemble(df, spark, "majority", [1.0] * 3, link=True).select("subject_start_idx", "subject_text_span", "predicate", "score", "confscore").collect()
    item, value, models, mean = ensemble.mixed_votes(*(np.array(x) for x in zip(*votes)), 60, 2)
    own = [(k if k < 60 else None, f"s{texts[k] if k < 60 else k - 60}", PREDICATES[v], float(n), round(c, 6)) for k, v, n, c in zip(item.tolist(), value.tolist(), models.tolist(), mean.tolist())]
    assert len(own) > 10 and sorted(own, key=str) == sorted(map(tuple, known), key=str)
    assert [len(x) for x in ensemble.mixed_votes(*[np.zeros(0, int)] * 3, np.zeros(0, bool), np.zeros(0, int), np.zeros(0), 0, 2)] == [0] * 4
