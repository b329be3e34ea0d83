"""Prefix trie of conversations by preorder intervals.

Every conversation becomes a sequence of turns (role, text); each distinct prefix is a node.
Nodes are named by hashes of their whole prefix: the running xor of 128-bit hashes of (place,
turn), so a node needs no row of its ancestors. Distinct conversations are then sorted so
that those below one node are next to each other; a node is the interval of their ranks, from
the first to the last. Nodes in order of (first, depth) are in preorder, so what a subtree
sums up (childless nodes, saved text) is the difference of two prefix sums: that after the
last node with a rank of the interval, and that before the node itself.

All running values are made by `running`: rows are dealt by range, each task runs through its
sorted rows, and the tasks' totals, a row each, are carried over. So a conversation of any
length, or a first turn of any number of conversations, is spread over tasks. The key that
conversations are sorted by holds only the turns after which the trie branches; along an
unbranched part, shorter ones come first.

Edge cases: turns are ordered by turn (null first), ties by role and then text, so repeated
rows are turns each; null roles and texts are empty; rows with a null conv_id belong to no
conversation; an empty table gives no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import join_skewed, map_arrow, pieces, stored

#: About so many rows go to a task of a running sum.
TASK_ROWS = 500_000
#: A key with so many rows is joined by a broadcast.
HOT = 4096
NOTHING = hashlib.sha256().hexdigest()


def running(df: DataFrame, order: list[str | Column], sums: list[str], xors: list[str], name: str, segment: str | None = None) -> DataFrame:
    """df with <column>_upto: sum or xor of the longs in all rows up to this one, in an order; with segment (a long, first in the order), since it began."""
    columns = df.columns
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces(df.count(), TASK_ROWS))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    each = [(c, np.add, 0) for c in sums] + [(c, np.bitwise_xor, 0) for c in xors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, now, held, whole = TaskContext.get().partitionId(), None, dict.fromkeys(sums + xors, 0), True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(columns.index(segment)).to_numpy() if segment else np.zeros(batch.num_rows, np.int64)
            begins = np.concatenate([[now is None or own[0] != now], own[1:] != own[:-1]])
            before = whole if now is None or own[0] == now else False
            head = np.zeros(batch.num_rows, bool)  # rows of the task's first segment, which may have begun in an earlier task
            if before:
                head[: np.flatnonzero(begins[1:])[0] + 1 if begins[1:].any() else len(head)] = True
            whole = bool(head[-1])
            starts = np.maximum.accumulate(np.where(begins, np.arange(len(own)), -1))
            made = []
            for c, f, _ in each:
                x = batch.column(columns.index(c)).to_numpy().astype(np.int64)
                total = f.accumulate(x)
                earlier = np.where(starts > 0, total[starts - 1], 0)  # where starts is -1, the segment goes on from the batch before
                total = total - earlier if f is np.add else total ^ earlier
                total = np.where(starts < 0, f(total, held[c]), total)
                held[c] = int(total[-1])
                made.append(pa.array(total))
            now = own[-1]
            yield pa.record_batch([*batch.columns, *made, pa.array([part] * len(own), pa.int64()), pa.array(own), pa.array(head)], [*columns, *(f"{c}_upto" for c, _, _ in each), "_part", "_segment", "_head"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}_upto` long" for c, _, _ in each), "_part long", "_segment long", "_head boolean"])
    made = stored(map_arrow(dealt, run, schema), name)
    # What each task adds to the segment that goes on in the next one: a row a task.
    ends = made.withColumn("_at", F.monotonically_increasing_id()).groupBy("_part").agg(F.min_by("_segment", "_at").alias("first"), F.max_by("_segment", "_at").alias("last"), F.min("_head").alias("whole"), *(F.max_by(f"{c}_upto", "_at").alias(c) for c, _, _ in each))
    carried, segment_now, totals = [], None, dict.fromkeys(sums + xors, 0)
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        goes_on = segment_now is not None and r["first"] == segment_now
        carried.append((r["_part"], *((totals[c] if goes_on else 0) for c, _, _ in each)))
        for c, f, _ in each:
            totals[c] = int(f(totals[c], r[c])) if goes_on and r["whole"] else r[c]
        segment_now = r["last"]
    if not carried:
        return made.drop("_part", "_segment", "_head")
    more = df.sparkSession.createDataFrame(carried, ", ".join(["_part long", *(f"_{c} long" for c, _, _ in each)]))
    joined = made.join(F.broadcast(more), "_part")
    value = lambda c, f: F.col(f"{c}_upto") + F.col(f"_{c}") if f is np.add else F.col(f"{c}_upto").bitwiseXOR(F.col(f"_{c}"))
    return joined.select(*columns, *(F.when(F.col("_head"), value(c, f)).otherwise(F.col(f"{c}_upto")).alias(f"{c}_upto") for c, f, _ in each))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (from 1), t1, t2 (hashes of the turn), size (bytes of its text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).filter("conv_id is not null")
    turns = turns.select("*", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", "role").alias("t2"), F.octet_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("seq"))
    made = running(turns, ["conv_id", F.asc_nulls_first("turn"), "role", "text"], ["seq"], [], "turns", segment="conv_id")
    return made.select("conv_id", F.col("seq_upto").alias("seq"), "t1", "t2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, length of every conversation; and its turns with their place, as conversations are rebuilt.

    Conversation c takes the first h = crc32(c) % 9 turns of conversation c - c % 5, then its own after its first h.
    """
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversation-sizes")
    c = sizes.withColumns({"source": F.expr("conv_id - conv_id % 5"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9})
    c = c.join(sizes.select(F.col("conv_id").alias("source"), F.col("n").alias("there")), "source", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    c = stored(c.select("conv_id", "n", "source", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    first = turns.filter("seq <= 8").withColumnRenamed("conv_id", "source").join(c.drop("n"), "source").filter("seq <= head").select("conv_id", F.col("seq").alias("place"), "length", "t1", "t2", "size")
    own = join_skewed(turns, c.drop("source"), "conv_id", F.col("n") >= HOT).filter("seq > h").select("conv_id", (F.col("head") + F.col("seq") - F.col("h")).alias("place"), "length", "t1", "t2", "size")
    return c.select("conv_id", "length"), first.unionByName(own)


def named(turns: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations with the node they lead to and the one they come from, each a struct (depth, a, b)."""
    hashed = turns.select("conv_id", "place", "length", "size", F.xxhash64("place", "t1", "t2").alias("a"), F.xxhash64("t2", "t1", "place").alias("b"))
    made = running(hashed, ["conv_id", "place"], [], ["a", "b"], "prefixes", segment="conv_id")
    before = [F.col(f"{c}_upto").bitwiseXOR(F.col(c)).alias(c) for c in "ab"]
    return made.select("conv_id", "place", "length", "size", F.struct(F.col("place").alias("depth"), F.col("a_upto").alias("a"), F.col("b_upto").alias("b")).alias("node"), F.struct((F.col("place") - 1).alias("depth"), *before).alias("parent"))


def hashed_ends(ends: DataFrame) -> DataFrame:
    """node, first (the smallest conv_id), ends_sha256 of the conversations (node, conv_id) that end there.

    A hash runs over all ids in order: ids are joined in pieces of neighbouring ones first, and one task streams a node's pieces.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    some = ends.groupBy("node", F.shiftright("conv_id", 12).alias("piece")).agg(joined.alias("ids"), F.min("conv_id").alias("first"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = some.select("node.depth", "node.a", "node.b", "piece", "ids", "first").repartition(parts, "depth", "a", "b").sortWithinPartitions("depth", "a", "b", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now, state, first = None, None, None
        names = ["depth", "a", "b", "first", "ends_sha256"]
        row = lambda: (*now, first, state.hexdigest())
        out = []
        for batch in batches:
            for depth, a, b, _, ids, least in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, a, b) != now:
                    if now:
                        out.append(row())
                    now, state, first = (depth, a, b), hashlib.sha256(ids.encode()), least
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], names)
                out = []
        if now:
            yield pa.record_batch([pa.array([x]) for x in row()], names)

    made = map_arrow(dealt, run, "depth long, a long, b long, first long, ends_sha256 string")
    return made.select(F.struct("depth", "a", "b").alias("node"), "first", "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node, the root included."""
    convs, turns = rebuilt(numbered(conversations))
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    steps = named(turns)
    ends = stored(hashed_ends(steps.filter("place = length").select("node", "conv_id").unionByName(convs.filter("length = 0").select(root.alias("node"), "conv_id"))), "ends")

    # Nodes, with their numbers of conversations and of children.
    own = steps.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("size").alias("size"), F.first("parent").alias("parent"))
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(root.alias("node"), "n_convs", "conv_id", F.lit(0).cast("long").alias("size"), F.lit(None).cast("struct<depth:bigint,a:bigint,b:bigint>").alias("parent"))
    own = stored(own.unionByName(top), "nodes")
    children = own.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = stored(own.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")
    parents = own.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = stored(join_skewed(own.filter("parent is not null").drop("n_children"), parents, "parent", F.col("n_children") >= HOT).select("node", "n_convs", "parent_conv_id", F.col("n_children").alias("siblings")), "nodes-below")

    # One conversation of each distinct sequence; those are ranked by their turns after a branching node.
    single = ends.select(F.col("first").alias("conv_id"), F.col("node.depth").alias("depth"))
    kept = stored(join_skewed(steps.select("conv_id", "place", "node"), single, "conv_id", F.col("depth") >= HOT), "sequences")
    turning = join_skewed(kept, below.filter("siblings > 1").select("node", "n_convs"), "node", F.col("n_convs") >= HOT)
    keys = turning.groupBy("conv_id").agg(F.array_sort(F.collect_list("node")).alias("key"))
    ranked = running(single.join(keys, "conv_id", "left").select("conv_id", "depth", F.coalesce("key", F.array().cast("array<struct<depth:bigint,a:bigint,b:bigint>>")).alias("key"), F.lit(1).cast("long").alias("rank")), ["key", "depth"], ["rank"], [], "ranks").select("conv_id", "depth", F.col("rank_upto").alias("rank"))
    spans = join_skewed(kept.select("conv_id", "node"), ranked, "conv_id", F.col("depth") >= HOT).groupBy("node").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    whole = ranked.agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter("first is not null").select(root.alias("node"), "first", "last")

    # Preorder: prefix sums over nodes in order of (first, depth).
    placed = own.join(spans.unionByName(whole), "node").select("node", "conv_id", "n_convs", "n_children", "first", "last", F.col("node.depth").alias("depth"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    summed = running(placed, ["first", "depth"], ["leaf", "saved"], [], "preorder")
    after = summed.groupBy(F.col("first").alias("last")).agg(F.max("leaf_upto").alias("leaf_end"), F.max("saved_upto").alias("saved_end"))
    made = summed.join(after, "last").join(below.select("node", "parent_conv_id"), "node", "left").join(ends.select("node", "ends_sha256"), "node", "left")
    return made.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf_end") - F.col("leaf_upto") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_upto") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
