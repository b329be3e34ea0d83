"""Learnt sentence boundaries; subword pieces, their places and their inverse."""

import json
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from annolake.functions import subwords
from annolake.operators import docred, sentences

TEXT = "paper_id string, location string, text string"


def prose(rng, count=400):
    """Texts with abbreviations, initials, numbers and pairs of them with names; and where their sentences really end."""
    nouns = ["cat", "dog", "river", "house", "tree", "stone", "bird", "road", "cloud", "field", "garden", "window"]
    verbs = ["saw", "met", "found", "left", "liked", "passed"]
    texts, cuts = [], []
    for k in range(count):
        text, ends = "", []
        for _ in range(rng.randint(3, 7)):
            subject = rng.choice(["The", "A", "This", "However, the"]) + " " + rng.choice(nouns)
            middle = rng.choice([f"approx. {rng.randint(2, 99)} {rng.choice(nouns)}s", f"Dr. {rng.choice(['Smith', 'Jones', 'Brown'])}", f"a {rng.choice(nouns)}, e.g. a {rng.choice(nouns)},", f"J. {rng.choice(['Smith', 'Jones'])}", f"the {rng.choice(nouns)} and the {rng.choice(nouns)}", f"it (see fig. {rng.randint(1, 9)})"])
            text += f"{subject} {rng.choice(verbs)} {middle} near the {rng.choice(nouns)}{rng.choice(['.', '.', '.', '!', '?'])}"
            ends.append(len(text))
            text += rng.choice([" ", "  ", "\n"])
        texts.append((f"p{k}", "abstract", text))
        cuts.append(ends)
    return texts, cuts


def test_abbreviations_do_not_end_sentences(spark):
    texts, cuts = prose(random.Random(0))
    df = spark.createDataFrame([*texts, ("q", "title", ""), ("r", "title", None), ("s", "title", "No end"), ("t", "title", "  One. Two  ")], TEXT).repartition(5)
    known = sentences.learnt(df)
    found = {r["type"] for r in known.abbreviations.collect()}
    assert {"approx", "dr", "e.g", "fig"} <= found and not found & {"cat", "dog", "river", "house", "tree", "stone"}
    assert {"a", "this"} <= {r["type"] for r in known.starters.collect()}
    rows = sentences.split(df, known).collect()
    own = {}
    for r in sorted(rows, key=lambda r: (r["paper_id"], r["i"])):
        own.setdefault(r["paper_id"], []).append((r["s"], r["e"], r["tok"]))
    real = sum(map(len, cuts))
    good = 0
    for (p, _, text), ends in zip(texts, cuts):
        assert "".join(x[2] for x in own[p]) == text and [x[0] for x in own[p]] == [0, *(x[1] for x in own[p][:-1])]
        at = {s + len(t.rstrip()) for s, _, t in own[p]}
        good += len(at & set(ends))
        assert len(at) <= len(ends) + 1
    assert good >= 0.98 * real
    by_pattern = sum(len(re.findall(docred.SENTENCE, t[2])) for t in texts)
    assert by_pattern > 1.3 * real  # what the plain pattern takes for sentences
    assert [x[2] for x in own["t"]] == ["  One. ", "Two  "] and [x[2] for x in own["s"]] == ["No end"] and "q" not in own and "r" not in own


def test_document_records_take_learnt_sentences(spark):
    texts, _ = prose(random.Random(1), 100)
    df = spark.createDataFrame(texts, TEXT)
    sents = sentences.split(df, sentences.learnt(df))
    entity = spark.createDataFrame([(p, loc, t.index(" "), t.index(" ") + 1, "gene", 0) for p, loc, t in texts], "paper_id string, location string, start_idx int, end_idx int, label string, ord int")
    merged = docred.merged_sentences(sents, entity)
    assert merged.count() == sents.count()
    assert docred.sentence_tokens(df.select("paper_id", "location", F.lit(0).alias("s"), F.lit(1).alias("e")), merged).count() == len(texts)


def test_scores_by_hand():
    """The ratio against its definition on counts."""
    import math

    def plain(both, first, second, total):
        part = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)
        p, p1, p2 = second / total, both / first, (second - both) / (total - first)
        return -2 * (part(both, first, p) + part(second - both, total - first, p) - part(both, first, p1) - part(second - both, total - first, p2)) if both * total > first * second else 0

    from pyspark.sql import SparkSession

    rows = [(5, 10, 20, 1000), (10, 10, 10, 1000), (1, 10, 500, 1000), (3, 30, 3, 50)]
    df = SparkSession.getActiveSession().createDataFrame(rows, "a int, b int, c int, d int")
    found = [r[0] for r in df.select(sentences.ratio(*(F.col(c) for c in "abcd"))).collect()]
    assert found == pytest.approx([plain(*r) for r in rows]) and found[0] > 20 and found[2] == 0


# --- pieces


def greedy(word, pieces, continues, ends, unknown="[UNK]"):
    """The longest piece at each place, tried from the longest down."""
    out, at = [], 0
    while at < len(word):
        for k in range(len(word), at, -1):
            name = (continues if at and continues else "") + word[at:k] + (ends if k == len(word) else "")
            if name in pieces and (continues == "" or at or not word[:k].startswith(continues)):
                out.append((name, at, k))
                at = k
                break
        else:
            return [(unknown, 0, len(word))]
    return out


@pytest.mark.parametrize(("continues", "ends"), [("##", ""), ("", "</w>")])
def test_longest_match_against_a_plain_search(continues, ends):
    rng = random.Random(3)
    for _ in range(300):
        bare = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        names = {x for b in bare for x in rng.sample([b, f"##{b}"] if continues else [b, b + ends], rng.randint(1, 2))}
        known = subwords.Vocabulary({x: k for k, x in enumerate(sorted(names))}, continues=continues, ends=ends)
        for _ in range(10):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 9)))
            assert known.cut(word) == greedy(word, names, continues, ends)


def public():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as lines:
        return json.load(lines)["model"]["vocab"]


def test_round_trip_of_a_public_vocabulary(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [(str(k), "abstract", t) for k, t in enumerate([*texts, "", None, "İstanbul ǅ", "unbelievable  tokenisation—works"])]
    df = spark.createDataFrame(rows, TEXT).repartition(3)
    known = subwords.Vocabulary(public(), continues="", ends="</w>", lower=True)
    parts = subwords.pieces(df, known)
    own = {}
    for r in parts.collect():
        own.setdefault(r["paper_id"], []).append((r["i"], r["piece"], r["id"], r["word"], r["s"], r["e"]))
    for p, _, text in rows:
        found = sorted(own.get(p, []))
        assert [x[0] for x in found] == list(range(len(found)))
        words = {}
        for _, piece, number, word, s, e in found:
            words[word] = words.get(word, "") + text[s:e]
            assert piece == "[UNK]" or (number is not None and piece.removesuffix("</w>") in (text[s:e], text[s:e].lower()))
        assert list(words.values()) == re.findall(r"\w+|[^\w\s]", text or "")
    joined = {r["paper_id"]: r["text"] for r in subwords.joined(parts.filter("piece <> '[UNK]'"), continues="", ends="</w>").collect()}
    spaced = lambda t: " ".join("".join(m[0].lower() for m in re.finditer(r"\w+|[^\w\s]", x)) for x in t.split())
    whole = [p for p, _, t in rows if t and not any(x[1] == "[UNK]" for x in own[p])]
    assert len(whole) > 30 and all(joined[p] == spaced(dict((r[0], r[2]) for r in rows)[p]) for p in whole)


def test_labels_between_words_and_pieces(spark):
    known = subwords.Vocabulary({x: k for k, x in enumerate(["un", "##do", "##ing", "it"])})
    parts = subwords.pieces(spark.createDataFrame([("p", "title", "undoing it")], TEXT), known)
    assert [(r["piece"], r["word"], r["s"], r["e"]) for r in parts.orderBy("i").collect()] == [("un", 0, 0, 2), ("##do", 0, 2, 4), ("##ing", 0, 4, 7), ("it", 1, 8, 10)]
    assert subwords.joined(parts).first()["text"] == "undoing it"
    tagged = parts.withColumn("label", F.when(F.col("word") == 0, "B-gene").otherwise("O"))
    assert [r["aligned"] for r in subwords.word_labels(tagged, "label").orderBy("i").collect()] == ["B-gene", None, None, "O"]
    back = subwords.labelled_words(tagged.withColumn("score", F.col("i") / 10), "label", "score").orderBy("word").collect()
    assert [(r["s"], r["e"], r["label"], r["score"]) for r in back] == [(0, 7, "B-gene", 0.0), (8, 10, "O", 0.3)]
    entity = spark.createDataFrame([("p", "title", 3, 8)], "paper_id string, location string, start_idx int, end_idx int")
    assert [(r["first_piece"], r["last_piece"]) for r in subwords.entity_pieces(parts, entity).collect()] == [(1, 3)]
    places = spark.createDataFrame([("p", "title", x) for x in (0, 6, 7, 9)], "paper_id string, location string, at int")
    assert [r["piece_no"] for r in subwords.piece_at(places, "at", parts).orderBy("at").collect()] == [0, 2, None, 3]
