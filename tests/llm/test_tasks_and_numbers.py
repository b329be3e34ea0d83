"""Caches of a worker process, and words numbered as bytes, many texts at once."""

from annolake.llm import common, language_model


def test_shape_takes_bytes():
    assert [language_model.shape(w.encode()) for w in ("a", "a.", "a,", "a!", "a#", "ä", "ä.", "aä", "ä|")] == [1, 2, 3, 4, 5, 6, 7, 6, 10]


def test_numbered_texts_are_whole_and_apart(spark):
    texts = ["a b c\x1cd A", None, "", "zz b zz. ä " * 3, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "false held_out")
    known = language_model.Vocabulary([("a", 3), ("b", 2)], 10, 4, {1: (3, 2)}, 5)
    rows = {r["doc_id"]: r for r in language_model.numbered(docs.coalesce(1), spark.sparkContext.broadcast(known)).collect()}
    assert {k: r["n_tokens"] for k, r in rows.items()} == {k: len(common.words(t, lower=True)) + 1 for k, t in enumerate(texts)}
    assert {k: r["n_known"] for k, r in rows.items()} == {0: 3, 1: 1, 2: 1, 3: 4, 4: 2}
    assert rows[0]["rest"] == {"b c\x1cd": 1} and rows[3]["rest"] == {"zz": 3, "zz.": 3, "ä": 3} and rows[1]["rest"] == rows[4]["rest"] == {}
    assert [len(rows[k]["ids"]) // 2 for k in range(5)] == [4, 1, 1, 13, 2] and all(r["ids"].endswith(b"\0\0") for r in rows.values())
