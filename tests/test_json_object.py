"""One-object JSON files: split reading, odd strings, errors with their line, round trips."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annolake.sources import json_object

SCHEMA = "a string, b array<struct<x:int,y:string>>, c struct<d:double>"
ODD = ["", "}", "{", '"', '\\"', "\\", "\\\\}", "[", "], {", 'x": {"', "line\nbreak", "é 日本 😀", "\t", "},\n  \"p\": {", "\\u0041"]


def corpus(rng, count):
    text = lambda: "".join(rng.choice(ODD) for _ in range(rng.randint(0, 5)))
    return {f"{k}{rng.choice(ODD)}": {"a": rng.choice([None, text()]), "b": [{"x": rng.randint(0, 9), "y": text()} for _ in range(rng.randint(0, 4))], "c": rng.choice([None, {"d": rng.random()}])} for k in range(count)}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain(found):
    return {r["key"]: {"a": r["content"]["a"], "b": None if r["content"]["b"] is None else [x.asDict() for x in r["content"]["b"]], "c": r["content"]["c"].asDict() if r["content"]["c"] else None} for r in found}


@pytest.mark.parametrize("layout", [{"indent": 2}, {}, {"separators": (",", ":")}, {"indent": 4, "ensure_ascii": False}])
def test_any_layout_in_many_tasks(spark, tmp_path, small_splits, layout):
    held = corpus(random.Random(len(layout)), 120)
    (tmp_path / "one.json").write_text("\n " + json.dumps(held, **layout) + "\n")
    (tmp_path / "two.json").write_text(json.dumps({"only": {"a": "x"}}, **layout))
    (tmp_path / "none.json").write_text("{ }\n")
    raw = json_object.pieces(spark, str(tmp_path / "one.json"))
    assert raw.rdd.getNumPartitions() > 10  # the file is read by many tasks
    found = json_object.read_object(spark, str(tmp_path), SCHEMA).collect()
    first = [r for r in found if r["file"].endswith("one.json")]
    assert plain(first) == held
    assert [r["key"] for r in sorted(first, key=lambda r: r["ord"])] == list(held)
    assert [(r["key"], r["content"]["a"]) for r in found if not r["file"].endswith("one.json")] == [("only", "x")]


def test_errors_name_file_and_line(spark, tmp_path, small_splits):
    lines = ["{"] + [f'"p{k}": {{"a": "{"x" * 50}"}},' for k in range(40)] + ['"bad": {"a": nonsense},', '"n": 1, "q": {"a": "y"},', '"last": {"a": "z"}', "}"]
    (tmp_path / "x.json").write_text("\n".join(lines))
    found = json_object.read_object(spark, str(tmp_path / "x.json"), "a string", strict=False)
    bad = {(r["key"], r["line"], r["error"]) for r in found.filter("error is not null").collect()}
    assert bad == {("bad", 42, "no JSON"), ("n", 43, "no object")}
    assert found.filter("error is null").count() == 41
    with pytest.raises(Exception, match=r"x\.json, line 4[23]: no"):
        json_object.read_object(spark, str(tmp_path / "x.json"), "a string").collect()
    (tmp_path / "cut.json").write_text('{"a": {"a": "x"}, "b": {"a": "cut o')
    with pytest.raises(Exception, match=r"cut\.json, line 1: no whole object"):
        json_object.read_object(spark, str(tmp_path / "cut.json"), "a string").collect()


def test_round_trip_in_order(spark, tmp_path):
    held = corpus(random.Random(7), 300)
    rows = [(k, n, json.dumps(v, ensure_ascii=False)) for n, (k, v) in enumerate(held.items())]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "key string, n int, content string").repartition(7)
    json_object.write_object(df, str(tmp_path / "out"), "key", "content", "n")
    (part,) = (tmp_path / "out").glob("part-*")
    assert json.loads(part.read_text()) == held and list(json.loads(part.read_text())) == list(held)
    again = json_object.read_object(spark, str(tmp_path / "out"), SCHEMA)
    assert plain(again.collect()) == held
    json_object.write_object(again, str(tmp_path / "structs"), "key", "content", "ord")
    (part,) = (tmp_path / "structs").glob("part-*")
    assert json.loads(part.read_text()) == held
    json_object.write_object(df.filter("n < 0"), str(tmp_path / "none"), "key", "content", "n")
    (part,) = (tmp_path / "none").glob("part-*")
    assert json.loads(part.read_text()) == {}


def test_a_file_of_a_hundred_megabytes(spark, tmp_path):
    """One line, 100 MB, twelve splits and more: as many tasks read it."""
    body = json.dumps({"a": "y" * 900 + '}"{', "b": [{"x": k, "y": "{"} for k in range(4)]})
    with open(tmp_path / "big.json", "w") as out:
        out.write("{" + ", ".join(f'"p{k}": {body}' for k in range(100_000)) + "}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        assert json_object.pieces(spark, str(tmp_path / "big.json")).rdd.getNumPartitions() >= 12
        found = json_object.read_object(spark, str(tmp_path / "big.json"), SCHEMA).agg(F.count("*"), F.count_distinct("key"), F.sum(F.size("content.b")), F.min("content.a"))
        assert tuple(found.first()) == (100_000, 100_000, 400_000, "y" * 900 + '}"{')
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
