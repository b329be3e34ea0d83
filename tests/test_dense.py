"""Vector search: the inverted file against the exact way, blocks and parts, odd vectors, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.operators import dense

SCHEMA = "id long, vector array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(int(k), None if v is None else [None if x is None else float(x) for x in v]) for k, v in rows], SCHEMA).repartition(5)


def clusters(rng, count, size, n=32, noise=0.15):
    centres = rng.normal(size=(count, n))
    return [(k, centres[k % count] + noise * rng.normal(size=n)) for k in range(count * size)]


def brute(queries, rows, k, threshold=-1.0):
    ids, x = np.array([i for i, _ in rows]), np.array([np.float32(v) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        v = np.array(np.float32(v), float)
        s = x @ (v / np.linalg.norm(v))
        out[q] = [ids[j] for j in np.lexsort((ids, -np.round(s, 12)))[:k] if s[j] >= threshold]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("most_bytes", [0, 64_000_000])
@pytest.mark.parametrize("threshold", [-1.0, 0.5])
def test_exact_search(spark, monkeypatch, most_bytes, threshold):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 100)
    monkeypatch.setattr(dense, "PART_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = clusters(rng, 20, 15) + [(1000 + k, rng.normal(size=32)) for k in range(50)]
    asked = [r for r in rows if r[0] % 20 == 0]
    found = lists(dense.nearest(frame(spark, asked).withColumnRenamed("id", "query_id"), frame(spark, rows), 4, threshold, most_bytes))
    assert found == {q: v for q, v in brute(asked, rows, 4, threshold).items() if v}


@pytest.mark.parametrize("most_bytes", [0, 64_000_000])
def test_odd_vectors_and_ties(spark, most_bytes):
    rows = frame(spark, [(1, [1, 0]), (2, [2, 0]), (3, [0, 1]), (4, [1, 0, 0]), (5, None), (6, []), (7, [0, 0]), (8, [1, None]), (9, [float("nan"), 1]), (10, [float("inf"), 1])])
    found = lists(dense.nearest(rows.withColumnRenamed("id", "query_id"), rows, 2, most_bytes=most_bytes))
    assert found == {1: [1, 2], 2: [1, 2], 3: [3, 1], 4: [4]}
    none = dense.nearest(rows.filter("id > 4").withColumnRenamed("id", "query_id"), rows, 2, most_bytes=most_bytes)
    assert none.collect() == [] and none.columns == ["query_id", "id", "score", "rank"]


@pytest.mark.parametrize("kind", ["clusters", "none", "one hot cluster"])
def test_recall_of_listed_search(spark, monkeypatch, kind):
    """On data with and without clusters, of which one may hold a third of all rows; queries are all ids divisible by 20."""
    monkeypatch.setattr(dense, "BLOCK_ROWS", 300)
    monkeypatch.setattr(dense, "PART_ROWS", 40)
    rng = np.random.default_rng(2)
    rows = {"clusters": lambda: clusters(rng, 60, 50), "none": lambda: [(k, rng.normal(size=32)) for k in range(3000)], "one hot cluster": lambda: clusters(rng, 40, 50) + [(5000 + k, np.ones(32) + 0.3 * rng.normal(size=32)) for k in range(1000)]}[kind]()
    df, asked = frame(spark, rows), [r for r in rows if r[0] % 20 == 0]
    known = dense.centroids(df, 5)
    assert len(known.points) == round(len(rows) ** 0.5) and (known.probes < 15 or kind != "clusters")
    listed = dense.index(df, known)
    assert listed.count() == len(rows)  # every row is in a list
    found = dense.search(frame(spark, asked).withColumnRenamed("id", "query_id"), listed, known, 5)
    exact = dense.nearest(frame(spark, asked).withColumnRenamed("id", "query_id"), df, 5)
    assert exact.count() == 5 * len(asked)
    assert dense.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    every = dense.search(frame(spark, asked).withColumnRenamed("id", "query_id"), listed, known, 5, probes=len(known.points))
    assert lists(every) == lists(exact)  # all lists opened: nothing is lost between blocks and parts


def test_small_and_empty_indexes(spark):
    one = frame(spark, [(1, [1, 2]), (2, None), (3, [1, 2, 3])])
    assert {q: v for q, v in lists(dense.nearest_listed(one.filter("id < 3").withColumnRenamed("id", "query_id"), one.filter("id < 3"), 3)).items()} == {1: [1]}
    assert dense.nearest_listed(one.withColumnRenamed("id", "query_id"), one.filter("id = 2"), 3).collect() == []


def test_registered_query_has_recall(spark):
    from annolake.plans import linking_relations, registry  # noqa: F401

    found, exact = (registry.QUERIES[n](spark, "/root/testdata/sf0.1") for n in ("link_ivf_topk", "link_knn_topk"))
    assert exact.count() == 500
    assert dense.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
