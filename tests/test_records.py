"""Small operators between record forms, on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from annolake.functions.text import json_string, parse_label
from annolake.operators import records, scoring
from annolake.sources import files

ENTITY = "paper_id string, location string, start_idx int, end_idx int, label string, uri string, ord int"


def test_labels_and_scores(spark):
    df = spark.createDataFrame([("p", "title", 0, 1, "gene", "C1", 0)], ENTITY).withColumn("predicted_label", F.lit(None).cast("string"))
    assert records.as_terms(df).first()["label"] == "term"
    assert records.with_fallback_label(df).first()["label"] == "gene"
    assert records.with_fallback_label(df.withColumn("predicted_label", F.lit("food"))).first()["label"] == "food"
    said = spark.createDataFrame([("0.5",), ("high",), (None,), ("NaN",), ("1e-3",)], "x string")
    assert [r[0] for r in said.select(records.numeric(F.col("x"))).collect()] == [0.5, None, None, None, 0.001]


def test_concepts(spark):
    df = spark.createDataFrame([("1", ["a b", "c", "d"], "what it is"), ("2", ["x"], None), ("3", [], None)], "id string, names array<string>, definition string")
    assert [tuple(r) for r in records.concept_rows(df).orderBy("id").collect()] == [("1", "a b", "what it is Sinonimi: c, d"), ("2", "x", "x"), ("3", None, None)]
    assert [tuple(r) for r in records.dictionary_rows(records.concept_rows(df).filter("id < '3'")).orderBy("id").collect()] == [("1", "a_b", True), ("2", "x", False)]
    asked = spark.createDataFrame([(1,), (2,), (2,)], "definition_id long")
    assert sorted((r["definition_id"], r["uri"]) for r in records.uris_of(asked, spark.createDataFrame([(2, "C2")], "definition_id long, uri string")).collect() if r["uri"]) == [(2, "C2"), (2, "C2")]


def test_linking_records(spark):
    df = spark.createDataFrame([("p", "title", 5, 6, "gene", None, 1), ("p", "title", 0, 1, "food", "C1", 0), ("p", "abstract", 0, 0, "gene", "C2", 2)], ENTITY)
    found = {r["id"]: [(x["start"], x["end"], x["label"]) for x in r["entities"]] for r in records.linking_records(df).collect()}
    assert found == {"p-title": [(0, 2, ["C1"]), (5, 7, ["-1"])], "p-abstract": [(0, 1, ["C2"])]}
    assert {r["id"]: r["entities"][0]["label"] for r in records.linking_records(df, "label", separator="_").collect()} == {"p_title": ["food"], "p_abstract": ["gene"]}
    answers = df.filter("ord = 0").unionByName(df.filter("ord = 0").withColumn("uri", F.lit("A1")))
    assert {r["ord"]: r["uri"] for r in records.written_back(df, answers).collect()} == {0: "A1", 1: "-1", 2: "-1"}


def test_counts_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "z"), (1, "x")], "g int, v string")
    assert {(r["g"], r["n"], r["removed"]) for r in records.removed(a.filter("g is not null"), a.filter("v = 'x' and g = 1"), "g").collect()} == {(1, 3, 1), (2, 1, 1)}
    assert records.removed(a, a.filter("v = 'x'")).first().asDict() == {"n": 5, "removed": 2}
    b = spark.createDataFrame([(1, "x"), (None, "z"), (9, "q")], "g int, v string")
    assert {r["op"]: r["n"] for r in records.set_sizes(a, b, ["g", "v"]).collect()} == {"union": 5, "intersect": 2, "fp": 1, "fn": 2}
    shares = records.source_shares(a.withColumnRenamed("v", "uri_source"))
    assert {r["uri_source"]: (r["n"], r["share"]) for r in shares.collect()} == {"x": (3, 0.6), "y": (1, 0.2), "z": (1, 0.2)}
    covered = spark.createDataFrame([("p", 2, 4)], "paper_id string, first_tok int, last_tok int")
    assert [r["tok"] for r in records.entity_tokens(covered).collect()] == [2, 3, 4]
    assert records.stacked([a, b.withColumn("more", F.lit(1))]).filter("more is null").count() == 5


def test_names_and_metadata_of_runs(tmp_path):
    paths = []
    for _ in range(3):
        *two, name = files.free_paths(str(tmp_path / "out"), "my run/1")
        paths.append(name)
        open(two[len(paths) % 2], "w").close()  # either file takes the name
    assert paths == ["my_run_1", "my_run_1_1", "my_run_1_2"]
    assert files.free_paths(str(tmp_path / "out"))[2] != files.free_paths(str(tmp_path / "out"))[2]
    with pytest.raises(ValueError):
        files.output_id("///")
    files.write_model_metadata(str(tmp_path / "model"), ["O", "B-gene"], {"epochs": 3, "path": tmp_path})
    assert files.read_label_mapping(str(tmp_path / "model")) == {0: "O", 1: "B-gene"}


def test_json_text_is_that_of_python(spark):
    values = ["", 'a "b" \\ c', "é 日本", "line\nfeed\ttab", *(f"x{chr(c)}y" for c in range(128)), "\\u000b", "\x0b\\"]
    found = spark.createDataFrame([(v,) for v in values], "v string").select("v", json_string(F.col("v")).alias("j")).collect()
    assert all(r["j"] == json.dumps(r["v"], ensure_ascii=False) for r in found) and len(found) == len(values)


def test_labels_by_list_order_or_length(spark):
    df = spark.createDataFrame([("a gene product",), ("GENE\nproduct",), ("none",)], "r string")
    found = df.select(parse_label(F.col("r"), ["gene", "gene product"]).alias("a"), parse_label(F.col("r"), ["gene", "gene product"], longest=False).alias("b")).collect()
    assert [tuple(r) for r in found] == [("gene product", "gene"), ("gene", "gene"), ("NA", "NA")]


def test_a_folder_of_predictions_is_scored(spark, tmp_path):
    entity = lambda s, label: {"start_idx": s, "end_idx": s + 1, "location": "title", "text_span": "ab", "label": label}
    for name, own in (("model_a", [entity(0, "gene"), entity(5, "food")]), ("model_b", [entity(0, "food")])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"1": {"metadata": {"title": "T", "abstract": ""}, "entities": own}}))
    (tmp_path / "notes.txt").write_text("no predictions")
    gold = spark.createDataFrame([("1", "title", 0, 1, "gene"), ("1", "title", 5, 6, "food")], "paper_id string, location string, start_idx int, end_idx int, label string")
    found = files.read_predictions(spark, str(tmp_path))
    scores = scoring.micro_macro(scoring.counted(found, gold, ["paper_id", "location", "start_idx", "end_idx", "label"], ["label"], ["name"]), ["name"])
    assert {r["name"]: round(r["micro_f1"], 6) for r in scores.collect()} == {"model a": 1.0, "model b": 0.0}


def test_missing_sort_column_warns(spark):
    table = spark.createDataFrame([(1, 0.5)], "n int, micro_f1 double")
    with pytest.warns(UserWarning, match="no column other"):
        assert files.merged_tables([table, table], "other").count() == 2
