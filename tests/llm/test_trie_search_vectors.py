"""op11, op12 and op13 against brute force, their parts, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.llm import collisions, lexical, prefix_trie

# --- op11

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string"


def rebuilt(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return made


def brute_trie(rows):
    made = rebuilt(rows)
    nodes = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    ends = {k: ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(k))) for k, members in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items())


def found_trie(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *(r[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))) for r in prefix_trie.trie(df).collect())


def talk(rng, count, most, words):
    """Conversations that share turns; some have turns twice, null turns, roles or texts, and an id below zero."""
    rows = []
    for c in rng.sample(range(-20, 10 * count), count):
        for turn in range(rng.randint(1, most)):
            row = (c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "assistant", None, ""]), rng.choice([*words, None]), "x")
            rows += [row] * rng.choice([1, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize(("seed", "count", "most", "words"), [(0, 60, 4, ["a", "é"]), (1, 40, 12, ["one", "two", ""]), (2, 200, 3, ["x"])])
def test_trie_against_brute_force(spark, seed, count, most, words):
    rows = [*talk(random.Random(seed), count, most, words), (None, 1, "user", "no conversation", "x")]
    assert found_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(7)) == brute_trie(rows)


def test_trie_of_hot_turns_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 20)  # joins by broadcast
    monkeypatch.setattr(prefix_trie, "TASK_ROWS", 100)  # the long conversation is spread over tasks
    rows = [(c, t, "user", ["all", "same", f"{c % 3}"][t], "x") for c in range(300) for t in range(3)]
    rows += [(5000, t, "user", f"turn {t}", "x") for t in range(700)] + [(5001, 0, "user", "a")[:4] + ("x",)] + [(5003, t, "user", "w " * t, "x") for t in range(40)]
    assert found_trie(spark.createDataFrame(rows, CONVERSATIONS)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 0, "user", "x", "y")], CONVERSATIONS)).collect() == []


@pytest.mark.parametrize("segmented", [True, False])
def test_running_sums_over_many_tasks(spark, monkeypatch, segmented):
    monkeypatch.setattr(prefix_trie, "TASK_ROWS", 37)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 5, 9]), k, rng.randrange(-(2**63), 2**63), rng.randrange(100)) for k in range(1000)]
    df = spark.createDataFrame(rows, "s long, k long, x long, n long")
    made = prefix_trie.running(df, ["s", "k"], ["n"], ["x"], "test", segment="s" if segmented else None)
    total, bits, at, want = 0, 0, None, []
    for s, k, x, n in sorted(rows):
        total, bits = (0, 0) if segmented and s != at else (total, bits)
        total, bits, at = total + n, bits ^ x, s
        want.append((s, k, total, bits))
    assert sorted((r["s"], r["k"], r["n_upto"], r["x_upto"]) for r in made.collect()) == want


# --- op12


def brute_ranks(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, collections.Counter(words(t))) for i, t in docs if words(t)]
    count, length = len(own), sum(c.total() for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(words(text))
    out = []
    for item, some in asked.items():
        scored = []
        for i, c in own:
            m = 100 - 50 + (50 * c.total() * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in some if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, k):
    docs = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, term string").repartition(5)
    made = lexical.search(lexical.build_index(docs), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, block int"), k)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in made.collect()), key=repr)


@pytest.mark.parametrize(("block", "pairs"), [(8192, 50_000), (16, 30)])
def test_search_against_brute_force(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "BATCH_PAIRS", pairs)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "naïve", "Ünï", "A", "0x1", "ß"]
    text = lambda n: rng.choice([" ", ", ", "_"]).join(rng.choice(vocabulary) if rng.random() < 0.9 else f"rare{rng.randrange(10**6)}" for _ in range(n))
    docs = [(k if rng.random() < 0.95 else None, text(rng.randrange(0, 60))) for k in range(300)]
    docs += [(k, t) for k, t in docs[:40]] + [(1000 + k, "w1 w2 w3") for k in range(50)] + [(2000, None), (2001, ""), (2002, "?!"), (2003, "w5 " * 30_000)]
    items = [(k, text(8)) for k in range(30)] + [(3, "w7 w8"), (None, "w1 w9"), (50, None), (51, ""), (52, "absent"), (53, "w5")]
    assert searched(spark, docs, items, 7) == brute_ranks(docs, items, 7)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")], 5) == searched(spark, [(1, "a b"), (2, "c")], [], 5) == searched(spark, [(1, None)], [(1, "a")], 5) == []


def test_slices_add_and_rank_as_numbers_do():
    rng = np.random.default_rng(2)
    for docs in (1, 63, 64, 500):
        numbers, slices = [], []
        for _ in range(rng.integers(1, 9)):
            own = np.sort(rng.choice(docs, rng.integers(1, docs + 1), replace=False)).astype(np.uint16)
            impact = rng.integers(1, 2 ** int(rng.integers(2, 40)), len(own))
            slices.append(lexical.spread(own, *lexical.impact_slices(impact), docs))
            numbers.append(np.zeros(docs, np.int64))
            numbers[-1][own] = impact
        total = sum(numbers)
        for k in (1, 5, docs + 3):
            places, scores = lexical.best(lexical.added(slices), k)
            want = sorted((-int(s), p) for p, s in enumerate(total) if s)[:k]
            assert sorted((-int(s), p) for s, p in zip(scores, places)) == want


# --- op13


def brute_links(rows, least):
    """rows: (vec_id, vector, label); links by cosine, and the smallest id that each reaches."""
    able = {i: (label, np.array(v, float)) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    link = collections.defaultdict(set)
    for a, (la, va) in able.items():
        for b, (lb, vb) in able.items():
            if a < b and la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= least:
                link[a].add(b)
                link[b].add(a)
    out = {}
    for i, *_ in rows:
        seen, rest = {i}, [i]
        while rest:
            more = link[rest.pop()] - seen
            seen |= more
            rest += more
        out[i] = (len(link[i]), min(seen))
    return out


def families(rng, sizes, noise, n=64):
    rows = []
    for k, size in enumerate(sizes):
        centre = rng.normal(size=n)
        rows += [(centre + noise * rng.normal(size=n) * (j > 0), k % 3) for j in range(size)]
    return [(int(i), [float(np.float32(x)) for x in v], int(label)) for i, (v, label) in zip(rng.permutation(len(rows)) * 3, rows)]


def linked(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string").repartition(6)
    return {r["vec_id"]: r for r in collisions.near_copies(df, **more).collect()}


@pytest.mark.parametrize(("sizes", "noise", "block"), [([1] * 200 + [2] * 100 + [9] * 10, 0.1, 1024), ([300] + [1] * 300 + [4] * 40, 0.09, 1024), ([260, 90] + [1] * 60, 0.09, 64)])
def test_links_against_brute_force(spark, monkeypatch, sizes, noise, block):
    monkeypatch.setattr(collisions, "BLOCK_ROWS", block)
    rows = families(np.random.default_rng(len(sizes)), sizes, noise)
    known, found = brute_links(rows, 0.98), linked(spark, rows)
    assert len(found) == len(rows)
    assert all(found[i]["n_links"] <= n for i, (n, _) in known.items())  # none below the threshold, none twice
    total = sum(n for n, _ in known.values())
    assert total > 150 and sum(r["n_links"] for r in found.values()) >= 0.98 * total
    some = [i for i, (n, _) in known.items() if n]
    assert sum(found[i]["component_id"] == known[i][1] for i in some) >= 0.97 * len(some)
    assert all(found[i]["component_id"] == i and found[i]["kept"] for i, (n, _) in known.items() if not n)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_recall_by_similarity(spark):
    """Pairs at and above the threshold, in families of two: every band of similarity is found, not only the bulk."""
    rng, rows, want = np.random.default_rng(9), [], []
    for k in range(400):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        cosine = [0.9801, 0.985, 0.99, 0.999][k % 4]
        rows += [(2 * k, a.tolist(), k % 2), (2 * k + 1, (cosine * a + math.sqrt(1 - cosine**2) * b).tolist(), k % 2)]
        want.append(cosine)
    found = linked(spark, rows)
    for band in set(want):
        own = [k for k, c in enumerate(want) if c == band]
        assert sum(found[2 * k]["n_links"] == 1 for k in own) >= 0.97 * len(own), band


def test_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(collisions, "HOT", 10)  # copies are joined by a broadcast
    one, other = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(k, one, 1) for k in range(100, 150)] + [(k, one, 2) for k in (1, 2)] + [(3, [2.0, 4.0, 6.0], 2), (4, one[:2], 2), (5, other, 2), (6, [-30.0, 10.0, 5.0], 2)]
    odd = [(7, None, 2), (8, [], 2), (9, [0.0, 0.0, 0.0], 2), (10, [1.0, None, 2.0], 2), (11, [1.0, float("nan"), 1.0], 2), (12, [float("inf"), 1.0, 1.0], 2), (13, one, None), (14, one, None)]
    found = linked(spark, [*rows, *odd, (5, other, 2), (None, one, 1)])
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in found.items() if i is not None and i < 100} == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False)} | {i: (0, i, True) for i, *_ in odd}
    assert all((found[k]["n_links"], found[k]["component_id"]) == (49, 100) for k in range(100, 150))
    assert found[None]["n_links"] == 0 and found[None]["kept"]
    assert linked(spark, []) == {}
    with pytest.raises(ValueError):
        collisions.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 0.2)


def test_counts_agree_and_are_calibrated():
    rng = np.random.default_rng(4)
    p, group = rng.normal(size=(150, 24)), np.repeat([0, 1, 2], 50)
    want = {(i, k) for i in range(150) for k in range(i + 1, 150) if group[i] == group[k] and (np.abs(p[i] - p[k]) <= 0.8).sum() >= 12}
    assert want and {*zip(*(x.tolist() for x in collisions.sparse_counts(p, group, 0.8, 12)))} == want
    assert {*zip(*(x.tolist() for x in collisions.dense_counts(p[:50], 0.8, 12)))} == {x for x in want if x[1] < 50}
    needed = collisions.needed_count()
    assert collisions.tail(collisions.PROJECTIONS, needed, collisions.within(collisions.WINDOW)) >= collisions.COUNT_RECALL > collisions.tail(collisions.PROJECTIONS, needed + 1, collisions.within(collisions.WINDOW))
    drawn, width = rng.normal(size=(200_000, 2)) @ np.array([[1, 1], [0, 1]]), collisions.CELL_WIDTH
    assert np.mean(np.floor((drawn[:, 0] - drawn[:, 1] + (x := rng.uniform(0, width, 200_000))) / width) == np.floor(x / width)) == pytest.approx(collisions.same_cell(width), abs=0.01)
    values, tables = zip(*(collisions.shape(n, 0.2) for n in (10, 10**4, 10**7)))
    assert list(values) == sorted(values) and list(tables) == sorted(tables)


def test_table_of_contracts(spark):
    """Columns and types of the registered queries."""
    from annolake.llm import queries

    made = {n: f(spark, "/root/testdata/sf0.001").dtypes for n, f in queries.queries().items() if n.startswith(("op11", "op12", "op13"))}
    assert made["op11_prefix_trie"] == [(c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", "string")]
    assert made["op12_impact_slices"] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert made["op13_collision_counting"] == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
