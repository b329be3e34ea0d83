"""The pipeline, stage by stage, on a small folder of tables."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from annolake.llm import packing, secrets, toxicity
from test_llm import BYTES, SCHEMA, brute_components, nested, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for k in range(240):
        text = prose(rng, rng.randint(20, 120))
        if k % 6 == 0:
            text = text.replace(" ", " vermin ", 1) + " vermin!"
        if k % 10 == 1:
            text += " password=abcdefgh" + str(k)
        if k % 10 == 2:
            text += " " + nested(f"token=abcdefgh{k}", ["base64"])
        rows.append((k, text, "en", "hot" if k % 3 else f"s{k % 4}", len(text)))
    for k in range(240, 300):
        own = rows[k - 239][1].split(" ")
        own[5] = "edited"
        rows.append((k, " ".join(own), "en", "copies", 0))
    rows += [(300, None, None, None, None), (301, "", "en", "hot", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA.split(", score")[0]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name == "packing":
            break
        assert made.columns == columns
        before, docs = docs, corpus_pipeline.stored(made, f"test-{name}")
        kept[name] = (before.collect(), docs.collect())
    before, after = kept["toxicity"]
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in after} == {k for k, p in scores.items() if not p} and all(k % 6 for k in (r["doc_id"] for r in after) if k < 240)
    before, after = kept["ngram_jaccard"]
    groups = brute_components({r["doc_id"]: r["text"] for r in before}, 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, (_, c) in groups.items() if c == k)
    before, after = kept["secrets"]
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        if texts[r["doc_id"]] is not None:
            assert r["text"] == secrets.masked(texts[r["doc_id"]], secrets.scan(texts[r["doc_id"]])[1], "[SECRET]") and r["n_chars"] == len(r["text"]) and "abcdefgh" not in r["text"]
    before, after = kept["mixing"]
    times = collections.Counter(r["doc_id"] for r in after)
    assert set(times) == {r["doc_id"] for r in before} and set(times.values()) <= {1, 2}
    pieces, filled = made.collect(), collections.Counter()
    for r in pieces:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024
    assert sum(filled.values()) == sum(len(np.frombuffer(packing.encode(r["text"] or "", BYTES), "<u4")) + 1 for r in after)


def test_run_gives_the_last_stage(spark, folder):
    made = corpus_pipeline.run(spark, folder)
    assert made.count() > 0 and "sequence_id" in made.columns
