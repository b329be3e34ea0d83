"""Many queries against few vectors: those are sent to the tasks, and the same is found."""

import numpy as np

from annolake.operators import dense, linking
from annolake.plans import models, registry  # noqa: F401  they register their queries


def test_few_vectors_find_what_nearest_finds(spark):
    rng = np.random.default_rng(1)
    make = lambda n, name: spark.createDataFrame([(f"x{k}", rng.integers(0, 3, 4 if k % 5 else 3).astype(float).tolist()) for k in range(n)], f"{name} string, vector array<double>")
    queries, few = make(200, "query_id").cache(), make(30, "id").cache()
    for k, threshold in ((1, -1.0), (3, 0.8)):
        known = sorted(map(str, dense.nearest(queries, few, k, threshold).select("query_id", "id", "score", "rank").collect()))
        for most in (65_536, 5):
            assert known and sorted(map(str, dense.nearest_of_few(queries, few, k, threshold, most).select("query_id", "id", "score", "rank").collect())) == known


def test_uris_of_all_labels(spark):
    rows = [("a", "gene", "C2"), ("A ", "drug", "C1"), ("a", "gene", "C3"), ("b", "drug", "C1"), ("b", "gene", "C1"), ("c", "gene", "")]
    df = spark.createDataFrame(rows, "text_span string, label string, uri string")
    known = linking.known_uris(df, ["text_norm"]).select("text_norm", "uris", "uri")
    assert sorted(linking.of_all_labels(linking.known_uris(df, ["text_norm", "label"])).select("text_norm", "uris", "uri").collect()) == sorted(known.collect())


def test_texts_are_cut_where_they_are_read(spark):
    plan = registry.QUERIES["link_routed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan and plan.count("MapInArrow") > 1
