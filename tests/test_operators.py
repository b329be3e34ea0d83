"""Operators on hand-written edge rows and against plain Python."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from annolake import config, providers
from annolake.functions import scores
from annolake.functions.text import json_string, mark_entity, mark_pair, occurrences, parse_label, split_term_label
from annolake.operators import docred, ensemble, linking, merge, relations, scoring, segment, spans
from annolake.schema import PREDICATES, valid_relations, valid_triples
from annolake.sources import files
from annolake.streaming import resume

SCHEMA = "paper_id string, location string, start_idx int, end_idx int, label string, ord int"


def entities(spark, rows):
    return spark.createDataFrame([("p", "title", s, e, l, k) for k, (s, e, l) in enumerate(rows)], SCHEMA)


def places(df):
    return sorted((r["start_idx"], r["end_idx"], r["label"]) for r in df.collect())


def test_schema_is_whole():
    assert len(valid_triples()) == 59 and len({t[:2] for t in valid_triples()}) == 54
    assert {t[2] for t in valid_triples()} == set(PREDICATES)


def test_first_label_of_a_span_wins(spark):
    assert places(spans.deduplicated(entities(spark, [(0, 3, "gene"), (0, 3, "food"), (0, 4, "food")]))) == [(0, 3, "gene"), (0, 4, "food")]


@pytest.mark.parametrize("rows, kept", [
    ([(0, 3, "a"), (3, 5, "b")], [(0, 3, "a"), (3, 5, "b")]),  # one shared character
    ([(0, 9, "a"), (2, 4, "b"), (5, 7, "c")], [(0, 9, "a")]),  # nested
    ([(0, 4, "a"), (3, 7, "b"), (6, 12, "c")], [(6, 12, "c")]),  # a chain
    ([(0, 4, "a"), (2, 6, "b")], [(0, 4, "a")]),  # equal lengths
])
def test_overlaps(spark, rows, kept):
    assert places(spans.without_overlaps(entities(spark, rows))) == kept


def test_overlaps_against_a_plain_walk(spark):
    rng = random.Random(4)
    rows = [(s, s + rng.randint(0, 9), "x") for s in (rng.randint(0, 120) for _ in range(60))]
    ordered = sorted(enumerate(rows), key=lambda x: (x[1][0], x[0]))
    clusters, reach = [], None
    for k, (s, e, _) in ordered:
        if reach is None or s >= reach:
            clusters.append([])
            reach = e
        clusters[-1].append((k, s, e))
        reach = max(reach, e)
    expected = sorted((s, e, "x") for c in clusters for k, s, e in [min(c, key=lambda x: (x[1] - x[2], x[1], x[0]))])
    assert places(spans.without_overlaps(entities(spark, rows))) == expected


def test_illegal_longest_span_deletes_a_legal_one(spark):
    assert places(spans.cleaned(entities(spark, [(0, 9, "nonsense"), (2, 4, "gene")]))) == []


def test_offsets_shift_and_return(spark):
    papers = spark.createDataFrame([("p", "four", "abs")], "paper_id string, title string, abstract string")
    some = spark.createDataFrame([("p", "title", 0, 3, "x", 0), ("p", "abstract", 0, 2, "x", 1)], SCHEMA)
    moved = spans.shifted(some, papers)
    assert sorted(r["start_idx"] for r in moved.collect()) == [0, 5]
    assert sorted(r["start_idx"] for r in spans.shifted(moved, papers, back=True).collect()) == [0, 0]


def test_bio_round_trip(spark):
    texts = spark.createDataFrame([("p", "title", "é big-dose word (x)"), ("p", "abstract", "")], "paper_id string, location string, text string")
    tokens = segment.tokenise(texts, segment.GLINER)
    assert "".join(r["tok"] for r in tokens.orderBy("i").collect()) == "é big-dose word (x)"
    some = entities(spark, [(0, 0, "gene"), (2, 9, "food"), (11, 14, "gene")])
    tagged = spans.bio_tags(tokens, some, typed=True).withColumn("score", F.lit(0.5))
    assert places(spans.merged_tags(tagged, typed=True)) == [(0, 0, "gene"), (2, 9, "food"), (11, 14, "gene")]
    odd = spark.createDataFrame([("p", "title", k, 2 * k, 2 * k + 1, t, 1.0) for k, t in enumerate(["I-a", "O", "I-a", "B-a", "I-b"])], "paper_id string, location string, i int, s int, e int, tag string, score double")
    assert [(r["start_idx"], r["end_idx"]) for r in spans.merged_tags(odd).orderBy("start_idx").collect()] == [(0, 4), (6, 8)]
    assert places(spans.merged_tags(odd, typed=True)) == [(0, 4, "a"), (6, 6, "a"), (8, 8, "b")]


def test_bad_offsets(spark):
    texts = spark.createDataFrame([("p", "title", "abc")], "paper_id string, location string, text string")
    found = spans.out_of_bounds(entities(spark, [(0, 2, "a"), (-1, 2, "a"), (0, 3, "a"), (2, 1, "a")]), texts)
    assert sorted(r["reason"] for r in found.collect()) == ["end", "order", "start"]


def plain_vote(votes, weights):
    totals = {}
    for m, value in votes:
        w, n = totals.get(value, (0, 0))
        totals[value] = (w + weights[m], n + 1)
    return min(totals, key=lambda v: (-totals[v][0], -totals[v][1], v)), totals


@pytest.mark.parametrize("method", ["majority", "weighted", "intersection", "union"])
def test_votes_against_plain_python(spark, method):
    rng, weights = random.Random(7), [0.5, 0.25, 0.25]
    rows = [(m, "p", "title", s, s + 1, rng.choice("abc"), k, rng.randint(0, 9) / 8) for k, (m, s) in enumerate(itertools.product(range(3), range(40))) if rng.random() < 0.7]
    made = ensemble.entity_ensemble(spark.createDataFrame(rows, "m int, " + SCHEMA + ", confscore double"), spark, method, weights)
    found = {r["start_idx"]: (r["label"], round(r["confscore"], 9)) for r in made.collect()}
    expected = {}
    for s in range(40):
        votes = [(r[0], r[5]) for r in rows if r[3] == s]
        if not votes:
            continue
        label, totals = plain_vote(votes, weights)
        score = totals[label][0] if method == "weighted" else totals[label][1]
        if method == "union" or score >= ensemble.threshold(method, weights):
            scores_ = [r[7] for r in rows if r[3] == s]
            expected[s] = (label, round(sum(scores_) / len(scores_), 9))
    assert found == expected


def test_methods_and_weights():
    assert ensemble.method_of("Majority-Voting") == "majority" and ensemble.threshold("majority", [1] * 4) == 3
    assert ensemble.threshold("union", [1, 1], 2.0) == 1.0 and ensemble.threshold("majority", [1, 1], 2.0) == 2.0
    for bad in ([1.0], [-1.0, 2.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            ensemble.checked_weights(bad, 2)
    with pytest.raises(ValueError):
        ensemble.method_of("mean")


def test_relation_votes_count_a_models_first_predicate(spark):
    row = lambda m, p, c: (m, "p", "title", 0, 1, "gene", 3, 4, "food", p, c)
    rows = [row(0, "affect", 0.5), row(0, "target", 0.9), row(1, "affect", 0.7), row(2, "target", 0.1)]
    some = spark.createDataFrame(rows, "m int, paper_id string, location string, subject_start_idx int, subject_end_idx int, subject_label string, object_start_idx int, object_end_idx int, object_label string, predicate string, confscore double")
    (made,) = ensemble.relation_ensemble(some, spark, "majority", [1.0] * 3).collect()
    assert made["predicate"] == "affect" and made["confscore"] == pytest.approx(0.6)
    assert sorted(r["predicate"] for r in ensemble.relation_ensemble(some, spark, "union", [1.0] * 3).collect()) == ["affect", "target"]


def test_merge_modes(spark):
    terms, classes = entities(spark, [(0, 1, "t"), (3, 4, "t"), (6, 7, "t")]), entities(spark, [(0, 1, "gene"), (0, 1, "food"), (3, 4, "NA")]).withColumn("confscore", F.lit(0.5))
    assert places(merge.merged(terms, classes)) == [(0, 1, "food")]
    assert len(merge.merged(terms, classes, include_na=True).collect()) == 2
    assert [r["start_idx"] for r in merge.missing(terms, classes).collect()] == [6]
    with pytest.raises(Exception, match="no label for"):
        merge.merged(terms, classes, mode="error").collect()


def test_scores_by_hand(spark):
    gold = entities(spark, [(0, 1, "a"), (2, 3, "a"), (4, 5, "b"), (4, 5, "b")])
    predicted = entities(spark, [(0, 1, "a"), (4, 5, "b"), (8, 9, "c")])
    (r,) = scoring.micro_macro(scoring.counted(predicted, gold, [*spans.SPAN, "label"], ["label"], []), []).collect()
    assert r["precision"] == pytest.approx(1) and r["recall"] == pytest.approx(0.5) and r["micro_precision"] == pytest.approx(2 / 3) and r["micro_recall"] == pytest.approx(0.5)
    (s,) = scoring.set_scores(predicted, gold, [*spans.SPAN, "label"]).collect()
    assert (s["tp"], s["fp"], s["fn"]) == (2, 1, 1) and s["f1"] == pytest.approx(2 / 3)
    (z,) = scoring.set_scores(predicted.filter("false"), gold.filter("false"), spans.SPAN).collect()
    assert (z["precision"], z["recall"], z["f1"]) == (0, 0, 0)
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    (m,) = scoring.multiclass(pairs, "t", "p").collect()
    assert m["accuracy"] == pytest.approx(2 / 3) and m["f1_macro"] == pytest.approx(2 / 3)


def test_cascade_and_priors(spark):
    known = spark.createDataFrame([("X ", "gene", "C2"), ("x", "gene", "C1"), ("y", "food", "C3"), ("z", "food", None), ("z", "food", "")], "text_span string, label string, uri string")
    by_label, by_text = linking.known_uris(known, ["text_norm", "label"]), linking.known_uris(known, ["text_norm"])
    asked = spark.createDataFrame([("x", "gene"), ("Y", "gene"), ("z", "food")], "text_span string, label string")
    found = {r["text_span"]: (r["uri"], r["uri_source"]) for r in linking.cascade(asked, by_label, by_text).collect()}
    assert found == {"x": ("C1", "text_label"), "Y": ("C3", "text"), "z": ("NA", "none")}
    rows = spark.createDataFrame([("1", "a", 0), ("1", "b", 1), ("", "c", 2), ("2", " ", 3)], "id string, name string, line int")
    assert [(r["id"], r["name"]) for r in linking.dictionary(rows, "line").collect()] == [("1", "a")]
    seen = spark.createDataFrame([("m", "1"), (" ", "1"), ("m", "NIL"), ("m", None), ("m", "9")], "text_span string, uri string")
    assert sorted(r["reason"] for r in linking.mention_reasons(seen, rows.limit(1).select("id", "name")).collect()) == ["counted", "missing_mention", "nil", "nil", "unknown_uri"]


def test_nearest_against_plain_python(spark):
    rng = random.Random(3)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(50)]
    df = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(5)
    found = {(r["query_id"], r["rank"]): r["id"] for r in linking.nearest(df.filter("id < 4").withColumnRenamed("id", "query_id"), df, 3).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q in range(4):
        best = sorted(vectors, key=lambda v: (-cos(vectors[q][1], v[1]), v[0]))[:3]
        assert [found[(q, k)] for k in (1, 2, 3)] == [b[0] for b in best]
    every = df.withColumnRenamed("id", "query_id")
    rows = [sorted(map(tuple, linking.nearest(every, df, 3, most_bytes=most).select("query_id", "rank", "id").collect())) for most in (10, 64_000_000)]
    assert rows[0] == rows[1] and len(rows[0]) == 3 * df.count()


def test_pairs_and_gates(spark):
    some = entities(spark, [(0, 1, "gene"), (2, 3, "bacteria"), (3, 6, "chemical"), (8, 9, "statistical technique")])
    pairs = relations.gated(relations.ordered_pairs(some), valid_relations(spark))
    labels = {(r["subject_label"], r["object_label"]) for r in pairs.collect()}
    assert labels == {("bacteria", "gene"), ("bacteria", "chemical"), ("chemical", "bacteria"), ("chemical", "gene")}
    assert {(r["subject_label"], r["object_label"]) for r in relations.apart(pairs).collect()} == {("bacteria", "gene"), ("chemical", "gene")}
    assert relations.forward_pairs(some).count() == 6


def test_valid_pairs_are_gated_pairs(spark):
    rng = random.Random(8)
    labels = ["gene", "bacteria", "chemical", "food", "human", "none", None]
    rows = [(f"p{k % 3}", rng.choice(["title", "abstract"]), k, k, rng.choice(labels), k) for k in range(80)]
    some, valid = spark.createDataFrame(rows, SCHEMA), valid_relations(spark)
    same = lambda a, b: sorted(map(repr, a.select(sorted(b.columns)).collect())) == sorted(map(repr, b.select(sorted(b.columns)).collect())) and a.count() > 50
    assert same(relations.valid_pairs(some, valid), relations.gated(relations.forward_pairs(some), valid))
    assert same(relations.valid_pairs(some, valid, both_ways=True), relations.gated(relations.ordered_pairs(some), valid))
    assert same(relations.valid_pairs(some.withColumnRenamed("location", "section"), valid, "section", by=("paper_id",)), relations.gated(relations.cross_pairs(some), valid))


def test_markers(spark):
    one = spark.createDataFrame([("abcdef",)], "t string")
    n = lambda *x: [F.lit(k) for k in x]
    (r,) = one.select(mark_entity(F.col("t"), *n(0, 5)), mark_pair(F.col("t"), *n(0, 2, 3, 5)), mark_pair(F.col("t"), *n(4, 5, 0, 0))).collect()
    assert list(r) == ["[E1]abcdef[/E1]", "[E1]abc[/E1][E2]def[/E2]", "[E2]a[/E2]bcd[E1]ef[/E1]"]


@pytest.mark.parametrize("text, term, starts", [("Aa aa", "aa", [0, 3]), ("a.b axb A.B", "a.b", [0, 8]), ("x\\Ey", "\\e", [1]), ("aaa", "aa", [0]), ("none", "z", []), ("", "z", []), ("(IL-6) il-6", "IL-6", [1, 7])])
def test_occurrences(spark, text, term, starts):
    (r,) = spark.createDataFrame([(text, term)], "t string, w string").select(occurrences(F.col("t"), F.col("w")).alias("x")).collect()
    assert r["x"] == starts


def test_labels_and_lines(spark):
    said = ["GENE\nmore", "label: anatomical location", "no idea", "it is a dietary supplement.", ""]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in said], "r string").select(parse_label(F.col("r"))).collect()]
    assert found == ["gene", "anatomical location", "NA", "dietary supplement", "NA"]
    lines = ["a | b", "a: b", "a - b", "a: b | c", "alone"]
    made = [(r["x"]["term"], r["x"]["label"]) for r in spark.createDataFrame([(x,) for x in lines], "l string").select(split_term_label(F.col("l")).alias("x")).collect()]
    assert made == [("a", "b"), ("a", "b"), ("a", "b"), ("a: b", "c"), ("alone", "NA")]
    odd = 'q"\\\n\té'
    assert json.loads(spark.createDataFrame([(odd,)], "v string").select(json_string(F.col("v"))).first()[0]) == odd


def test_logits(spark):
    (r,) = spark.createDataFrame([([0.0, 2.0, 1.0],)], "z array<double>").select(scores.softmax(F.col("z")).alias("p"), scores.argmax(F.col("z")).alias("k"), scores.adaptive_labels(F.col("z")).alias("d"), scores.argmax(scores.masked(F.col("z"), F.array(F.lit(True), F.lit(False), F.lit(True)))).alias("m")).collect()
    assert sum(r["p"]) == pytest.approx(1) and (r["k"], r["d"], r["m"]) == (1, [1, 2], 2)


@pytest.mark.parametrize("said, terms", [('Here: ["a]b", "c"] done', ["a]b", "c"]), ("- a\n- b", ["a", "b"]), ("1. a\n2) b", ["a", "b"]), ("a, 'b'", ["a", "b"]), ("a\nb", ["a", "b"]), ("", []), (None, []), ('[{"term": "a"}]', ["a"]), ("[bad, json", ["[bad", "json"])])
def test_term_lists(said, terms):
    assert providers.terms_of(said) == terms


def test_providers(spark):
    texts = spark.createDataFrame([("p", "title", "some longer words here and there"), ("p", "abstract", "")], "paper_id string, location string, text string")
    found = providers.extract_entities(texts, providers.build("hash-tagger", every=1)).collect()
    assert sorted(r["text_span"] for r in found) == ["here", "longer", "some", "there", "words"]
    with pytest.raises(ValueError):
        providers.build("unknown")

    class Failing:
        def chat_completion(self, system, user, temperature=1.0):
            if user == "bad":
                raise RuntimeError
            return user.upper()

    asked = spark.createDataFrame([("s", "ok"), ("s", "bad")], "system string, user string")
    assert sorted((r["user"], r["response"]) for r in providers.answered(asked, Failing()).collect()) == [("bad", None), ("ok", "OK")]


def test_document_records(spark):
    texts = spark.createDataFrame([("p", "title", "One big-dose. Two end."), ("q", "title", "x")], "paper_id string, location string, text string")
    rows = [(0, 2), (4, 8), (9, 12), (9, 15), (14, 16)]
    some = spark.createDataFrame([("p", "title", s, e, "gene", f"C{k}", k, "t") for k, (s, e) in enumerate(rows)], SCHEMA.replace("ord", "uri string, ord") + ", text_span string")
    assert docred.with_enough_entities(some.union(some.limit(1).withColumn("paper_id", F.lit("q")))).select("paper_id").distinct().count() == 1
    tokens = docred.split_tokens(segment.tokenise(texts, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\s+"), some)
    sents = docred.merged_sentences(segment.tokenise(texts, docred.SENTENCE), some)
    assert sents.filter("paper_id = 'p'").count() == 1  # the entity at 9..15 crosses the first end
    placed = docred.placed_entities(some, docred.sentence_tokens(tokens, sents))
    assert placed.count() == len(rows)
    record = next(r for r in docred.nested(placed, docred.sentence_tokens(tokens, sents)).collect() if r["title"] == "p-title")
    assert "".join(record["sents"][0]) == "Onebig-dose.Twoend." and len(record["vertexSet"]) == len(rows)


def test_files(spark, tmp_path):
    corpus = {"1": {"metadata": {"title": "T", "abstract": "A b"}, "entities": [{"start_idx": 0, "end_idx": 0, "location": "title", "text_span": "T", "label": "gene"}]}, "2": {"title": "top", "abstract": "level"}}
    for name, own in (("b", corpus), ("a", {"1": corpus["1"]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(corpus if name == "b" else own))
    assert [p.rsplit("/", 1)[1] for p in files.prediction_files(spark, str(tmp_path))] == ["a.json", "b.json"]
    read = files.read_corpus(spark, str(tmp_path / "b.json"))
    assert {r["paper_id"]: r["title"] for r in files.papers(read).collect()} == {"1": "T", "2": "top"}
    assert files.entities(read).count() == 1
    assert files.merged_corpora([read, files.read_corpus(spark, str(tmp_path / "a.json"))]).count() == 2
    files.write_corpus(files.papers(read), files.entities(read), str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted(k for r in again for k in json.loads(r[0])) == ["1", "2"]
    files.append_checkpoint(spark.createDataFrame([("1", 1)], "id string, n int"), str(tmp_path / "ck"))
    (tmp_path / "ck" / "z.json").write_text('{"id": "2", "n": 5}\n\n{"id": "3", "n"')
    assert sorted((r["id"], r["n"]) for r in files.read_checkpoint(spark, str(tmp_path / "ck"), "id string, n int").collect()) == [("1", 1), ("2", 5)]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "ck"), "id string, n int").collect()
    assert files.read_jsonl(spark, str(tmp_path / "ck"), "id string, n int", strict=False).count() == 2
    assert files.safe_name("a b//c*" * 40)[:6] == "a_b_c_" and files.display_name("my_run.json") == "my run"
    files.write_sidecar(str(tmp_path / "s" / "x.json"), {"run_config": {"a": 1}})
    assert files.read_sidecar(str(tmp_path / "s" / "x.json")) == {"a": 1}
    table = spark.createDataFrame([("x", 0.5), ("y", 0.7)], "name string, micro_f1 double")
    files.write_table(table, str(tmp_path / "csv"))
    merged = files.merged_tables(files.read_tables(spark, [str(tmp_path / "csv")] * 2), "micro_f1")
    assert [r["micro_f1"] for r in merged.collect()] == [0.7, 0.7, 0.5, 0.5]


def test_settings():
    held = {"a": {"b": 1}, "c": "x"}
    assert config.overridden(held, ["a.b=2", "d.e=true"]) == {"a": {"b": 2}, "c": "x", "d": {"e": True}} and held == {"a": {"b": 1}, "c": "x"}
    for bad in (["a.z=1"], ["q.b=1"], ["a"]):
        with pytest.raises(ValueError):
            config.overridden(held, bad, strict=True)
    with pytest.raises(ValueError):
        config.required({"a": ""}, ["a"])


def arrived(tmp_path, number, lines):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{number}.json").write_text("\n".join(lines))


def test_stream_takes_only_what_is_new(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    work = lambda df: df.withColumn("size", F.length("text"))
    for k, lines in enumerate((['{"paper_id": "1", "text": "abc"}', '{"paper_id'], ['{"paper_id": "1", "text": "abc"}', '{"paper_id": "2", "text": "d"}', '{"paper_id": "2", "text": "d"}', '{"paper_id": "9", "text": "done"}'])):
        arrived(tmp_path, k, lines)
        done = spark.createDataFrame([("9",)], "paper_id string")
        resume.process_new(spark, source, "paper_id string, text string", work, sink, check, done=done).awaitTermination()
    assert sorted((r["paper_id"], r["size"]) for r in resume.results(spark, sink).collect()) == [("1", 3), ("2", 1)]


def test_stream_killed_between_write_and_commit(spark, tmp_path):
    """The batch has written all its results when it dies; run again, it replaces them, and later batches still know its keys."""
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    run = lambda work: resume.process_new(spark, source, "paper_id string, text string", work, sink, check)
    work = lambda df: df.withColumn("size", F.length("text"))

    class Dying:
        def __init__(self, df):
            self.df = work(df)

        @property
        def write(self):
            return self

        def mode(self, mode):
            self.how = mode
            return self

        def parquet(self, path):
            self.df.write.mode(self.how).parquet(path)
            raise RuntimeError("killed")

    arrived(tmp_path, 0, [json.dumps({"paper_id": str(k), "text": "x" * k}) for k in range(50)])
    with pytest.raises(Exception, match="killed"):
        run(Dying).awaitTermination()
    assert resume.results(spark, sink).count() == 50  # written, but not committed
    arrived(tmp_path, 1, [json.dumps({"paper_id": str(k), "text": "new"}) for k in range(40, 60)])
    run(work).awaitTermination()
    run(work).awaitTermination()
    found = resume.results(spark, sink).collect()
    assert sorted(int(r["paper_id"]) for r in found) == list(range(60))
    assert {r["paper_id"]: r["size"] for r in found if int(r["paper_id"]) < 50} == {str(k): k for k in range(50)}


def test_relations_from_context_are_those_of_whole_texts(spark):
    from annolake import providers
    from annolake.functions.text import mark_pair_context
    from annolake.operators import relations, spans

    text = "alpha é beta, gamma " + "x" * 60 + " delta"
    texts = spark.createDataFrame([("p", "title", text), ("q", "abstract", "")], "paper_id string, location string, text string")
    marks = [("alpha", "bacteria"), ("beta", "chemical"), ("gamma", "chemical"), ("delta", "bacteria")]
    rows = [("p", "title", text.index(w), text.index(w) + len(w) - 1, label, k) for k, (w, label) in enumerate(marks)]
    entities = spark.createDataFrame(rows, "paper_id string, location string, start_idx int, end_idx int, label string, ord int")
    kind = providers.HashClassifier(PREDICATES)

    def found(window):
        made = providers.extract_relations(entities, texts, valid_relations(spark), kind, window)
        return sorted((r["subject_start_idx"], r["object_start_idx"], r["predicate"], r["confscore"]) for r in made.collect())

    assert found(None) == found(500) != []
    pairs = relations.ordered_pairs(spans.with_context(entities, texts, 5), "before", "text_span", "after").filter("subject_ord < object_ord")
    seen = {(r["subject_ord"], r["object_ord"]): r["x"] for r in pairs.select("subject_ord", "object_ord", mark_pair_context(5, "subject", "object", "E1", "E2").alias("x")).collect()}
    assert seen[0, 1] == "[E1]alpha[/E1] é [E2]beta[/E2], gam"
    assert seen[2, 3] == "eta, [E1]gamma[/E1] xxxx … xxxx [E2]delta[/E2]"


def test_illegal_relations_go(spark):
    rows = [("drug", "interact", "drug"), ("disease", "interact", "drug"), ("drug", "interact", "NA"), ("drug", "causes", "drug"), (None, "interact", "drug"), ("drug", None, "drug")]
    made = relations.legal(spark.createDataFrame(rows, "subject_label string, predicate string, object_label string"))
    assert [tuple(r) for r in made.collect()] == rows[:1]


def test_samples_that_lost_a_marker_go(spark):
    from annolake.functions.text import keeps_markers, marked_tokens

    texts = [("[E1]a b[/E1] c [E2]d[/E2]",), ("one two three four [E1]a[/E1] [E2]b[/E2]",), ("",), (None,)]
    kept = spark.createDataFrame(texts, "x string").select(keeps_markers(marked_tokens(F.col("x"), 6)).alias("k"), keeps_markers(marked_tokens(F.col("x"), 50)).alias("all"))
    assert [tuple(r) for r in kept.collect()] == [(True, True), (False, True), (False, False), (False, False)]


def test_knowledge_base_and_prompts_round_trip(spark, tmp_path):
    found = spark.createDataFrame([("Gut ", "human", "u2"), ("gut", "human", "u1"), ("gut", "food", "u3"), ("x", "food", None)], "text_span string, label string, uri string")
    tables = [linking.known_uris(found, ["text_norm"]), linking.known_uris(found, ["text_norm", "label"]), spark.createDataFrame([("d1", "u1")], "definition_id string, uri string")]
    files.write_knowledge_base(str(tmp_path / "kb"), *tables)
    stored = files.read_knowledge_base(spark, str(tmp_path / "kb"))
    (tmp_path / "t").write_text(json.dumps({"gut": ["u2", "u1", "u3"]}))
    (tmp_path / "l").write_text(json.dumps({json.dumps(["gut", "human"]): ["u2", "u1"], json.dumps(["gut", "food"]): ["u3"]}, indent=2))
    (tmp_path / "d").write_text(json.dumps({"d1": "u1"}))
    read = files.read_knowledge_base_json(spark, *(str(tmp_path / k) for k in "tld"))
    for name, table in zip(files.KNOWLEDGE, tables):
        rows = sorted(map(str, table.select(sorted(table.columns)).collect()))
        assert rows == [*sorted(map(str, stored[name].select(sorted(table.columns)).collect()))] == sorted(map(str, read[name].select(sorted(table.columns)).collect())) != []
    (tmp_path / "p").write_text(json.dumps({"system_prompts": {"base": "s", "long": "S"}, "user_prompts": {"base": "u {text}"}}))
    assert files.read_prompts(str(tmp_path / "p"), "long") == ("S", "u {text}")
    with pytest.raises(KeyError):
        files.read_prompts(str(tmp_path / "p"), user="none")
