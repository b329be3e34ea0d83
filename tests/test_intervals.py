"""Sweeps over places and intervals: against plain loops, and on one very long section."""

import random
import time

import pytest
from pyspark.sql import functions as F

from annolake.operators import docred, intervals, segment, spans

ENTITY = "paper_id string, location string, start_idx int, end_idx int, label string, ord int"
TOKEN = "paper_id string, location string, i int, tok string, s int, e int"


def made(spark, rng, sections=6, size=120, count=14):
    """Tokens that partition texts, of which some are blank, and entities of any place and length, some beyond the text."""
    tokens, entities = [], []
    for k in range(sections):
        s, i = 0, 0
        while s < size and k:  # the first section has none
            e = s + rng.randint(1, 6)
            tokens.append((f"p{k % 3}", "title" if k < 3 else "abstract", i, rng.choice([" " * (e - s), "abcdef"[: e - s]]), s, e))
            s, i = e, i + 1
        for n in range(count if k % 4 else 0):
            start = rng.randint(-3, size)
            entities.append((f"p{k % 3}", "title" if k < 3 else "abstract", start, start + rng.choice([0, 1, 5, 40]), rng.choice(["gene", "food"]), n))
    return tokens, entities


def frames(spark, tokens, entities):
    return spark.createDataFrame(tokens, TOKEN).repartition(3), spark.createDataFrame(entities, ENTITY).repartition(3)


def same(a, b):
    return a[:2] == b[:2]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_loops(spark, seed):
    tokens, entities = made(spark, random.Random(seed))
    t, n = frames(spark, tokens, entities)
    wide = {(*x[:2], x[5]): [y for y in tokens if same(x, y) and y[4] <= x[3] and y[5] - 1 >= x[2]] for x in entities}
    found = {(r["paper_id"], r["location"], r["ord"]): (r["first_tok"], r["last_tok"]) for r in segment.covered_tokens(t, n).collect()}
    assert found == {k: (min(y[2] for y in v), max(y[2] for y in v)) for k, v in wide.items() if v}

    for typed in (False, True):
        tags = {}
        for x in tokens:
            won = max((y for y in entities if same(x, y) and x[4] >= y[2] and x[5] - 1 <= y[3]), key=lambda y: y[5], default=None)
            tags[x[:3]] = "O" if won is None else ("B" if x[4] == won[2] else "I") + (f"-{won[4]}" if typed else "")
        assert {(r["paper_id"], r["location"], r["i"]): r["tag"] for r in spans.bio_tags(t, n, typed).collect()} == tags

    cut = {(*x[:2], x[4], x[5]): sorted({c for y in entities if same(x, y) for c in (y[2], y[3] + 1) if x[4] < c < x[5]}) for x in tokens if x[3].strip()}
    want = sorted((*k[:2], a, b) for k, v in cut.items() for a, b in zip([k[2], *v], [*v, k[3]]))
    assert sorted((r["paper_id"], r["location"], r["s"], r["e"]) for r in docred.split_tokens(t, n).collect()) == want

    # Sentences: runs of four tokens.
    bounds = {}
    for x in tokens:
        s, e = bounds.get((*x[:2], x[2] // 4), (x[4], x[5]))
        bounds[(*x[:2], x[2] // 4)] = min(s, x[4]), max(e, x[5])
    sents = spark.createDataFrame([(*k, "", *v) for k, v in bounds.items()], TOKEN)
    want, at = [], None
    for (p, loc, i), (s, e) in sorted(bounds.items()):
        if at and at[:2] == (p, loc) and any(y[:2] == at[:2] and y[2] < at[3] <= y[3] for y in entities):
            at = (*at[:3], e)
            want[-1] = at
        else:
            at = (p, loc, s, e)
            want.append(at)
    whole = docred.merged_sentences(sents, n)
    assert sorted((r["paper_id"], r["location"], r["s"], r["e"]) for r in whole.collect()) == sorted(want)
    inner = {(r["paper_id"], r["location"], r["s"]): r["sent_id"] for r in docred.sentence_tokens(t, whole).collect()}
    ids = {(r["paper_id"], r["location"], r["sent_id"]): (r["s"], r["e"]) for r in whole.collect()}
    assert inner == {(*x[:2], x[4]): k[2] for x in tokens for k, (s, e) in ids.items() if k[:2] == x[:2] and s <= x[4] and x[5] <= e}

    grams = [(p, loc, s, e, 1) for p, loc, _, _, s, e in tokens]
    free = segment.free_spans(spark.createDataFrame(grams, "paper_id string, location string, start_idx int, end_idx int, n int"), n)
    assert sorted(tuple(r) for r in free.select("paper_id", "location", "start_idx").collect()) == sorted(x[:3] for x in grams if not any(same(x, y) and y[2] <= x[3] and x[2] <= y[3] for y in entities))


def test_negative_spans_leave_brackets_and_entities_out(spark):
    words = segment.solid(segment.tokenise(spark.createDataFrame([("p", "title", "(one two) three four")], "paper_id string, location string, text string"), segment.WHITESPACE))
    n = spark.createDataFrame([("p", "title", 16, 19, "x", k) for k in range(20)], ENTITY)
    found = segment.negative_spans(segment.ngrams(words, 4), n, F.lit(0))
    assert sorted((r["start_idx"], r["end_idx"]) for r in found.collect()) == [(5, 14), (10, 14)]


def test_places_of_steps(spark):
    steps = spark.createDataFrame([("p", "title", k, k * 10) for k in range(5)], "paper_id string, location string, i int, s int")
    asked = spark.createDataFrame([("p", "title", x) for x in (-5, 0, 9, 10, 99)] + [("q", "title", 3), (None, "title", 3)], "paper_id string, location string, at int")
    before = intervals.at_or_before(asked, "at", steps, "s", {"k": "i"})
    after = intervals.first_after(asked, "at", steps, "s", {"k": "i"})
    assert {(r["paper_id"], r["at"]): r["k"] for r in before.collect()} == {("p", -5): None, ("p", 0): 0, ("p", 9): 0, ("p", 10): 1, ("p", 99): 4, ("q", 3): None, (None, 3): None}
    assert {(r["paper_id"], r["at"]): r["k"] for r in after.collect()} == {("p", -5): 0, ("p", 0): 1, ("p", 9): 1, ("p", 10): 2, ("p", 99): None, ("q", 3): None, (None, 3): None}


def test_a_section_of_a_million_tokens(spark):
    """All pairs would be 10^11 rows; the sweep takes seconds."""
    size = 1_000_000
    tokens = spark.range(size).selectExpr("'p' paper_id", "'abstract' location", "cast(id as int) i", "'ab' tok", "cast(2 * id as int) s", "cast(2 * id + 2 as int) e")
    n = spark.range(size // 10).selectExpr("'p' paper_id", "'abstract' location", "cast(20 * id + 2 as int) start_idx", "cast(20 * id + 5 as int) end_idx", "'gene' label", "cast(id as int) ord")
    began = time.time()
    assert {r["tag"]: r["count"] for r in spans.bio_tags(tokens, n).groupBy("tag").count().collect()} == {"O": size - size // 5, "B": size // 10, "I": size // 10}
    assert segment.covered_tokens(tokens, n).agg(F.count("*"), F.sum(F.col("last_tok") - F.col("first_tok"))).first() == (size // 10, size // 10)
    sents = tokens.filter("i % 20 = 0").withColumn("e", F.col("s") + 40)
    assert docred.sentence_tokens(tokens, docred.merged_sentences(sents, n)).agg(F.count("*"), F.max("pos")).first() == (size, 19)
    assert docred.split_tokens(tokens, n.withColumn("end_idx", F.col("end_idx") - 1)).count() == size + size // 10
    assert time.time() - began < 240
