"""Exact Jaccard self-join of word-shingle sets by a token-group matrix.

A document's set holds its distinct n-word shingles as 64-bit hashes. All pairs with
``100 * |x & y| >= percent * |x | y|`` end in one component; the steps are

1. *Signatures.* Such a pair differs in at most D shingles, D from the sizes. Shingles are
   dealt by hash to D + 1 parts, so one part at least is the same in both sets; a part's
   content is hashed to a signature. Sizes fall in classes, and a set is entered in each
   class that a partner's size can reach. More parts are made than that, so that each set
   can leave out its weakest.
2. *Groups.* A signature's hub is the least set that has it. Each set is compared with
   the hub of most of its signatures; linked sets form groups. Then each set is compared with one hub of each other
   group that it shares a signature with. So a large group of copies costs a pair a set.
   Before sets are read, a small bitmap of each tells pairs that cannot link.
3. *Token-group matrix.* Where a signature still spans several groups, the sets whose
   bitmaps let them link are dealt to blocks of similar ones. Pairs of blocks meet; a
   block's union of shingles bounds what a query can share with any member, and only for
   queries that reach the bound the block is opened and its members compared.

Any pair that could link shares a signature, and is then in one group after step 2 or
compared in step 3, so no link is lost and nothing is capped. Equal sets count as one.

Edge cases: null or empty text, or text without words: n_shingles 0, linked with nothing;
fewer than n words: the whole sequence is one shingle; repeated rows of one doc_id count
as one document, of different texts of one doc_id the largest set (then the largest key)
gives its row, the others link as well; ties in a part's order fall to its signature; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import BROADCAST_ROWS, Cache, join_skewed, map_arrow, pieces, slices, stored, word_bytes, word_hash

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Shingles in a block of the matrix, about.
BLOCK_SHINGLES = 40_000
#: A class of sizes reaches from one limit to below this many times it.
CLASS_RATIO = 1.3
#: Parts that may be left out, as a share of those that linked sets can differ in.
SPARE = 0.4
#: Signatures that one task aggregates, about.
TASK_POSTINGS = 500_000
#: Sets of one signature that are compared at once.
RUN_SETS = 2_000
#: Documents of one set from which its class is broadcast to them.
HOT_COPIES = 1_000

_hashes = Cache(word_hash, 60_000)


@np.errstate(over="ignore")
def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    own = word_bytes(text, lower=True)
    if not own:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))
    width = min(n, len(ids))
    out = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * C + ids[k : len(ids) - width + 1 + k])
    return np.unique(out)


def linked(common: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (x + y - common)


def most_apart(largest: int, percent: int) -> int:
    """The symmetric difference of a linked pair whose larger set has `largest` members at most."""
    return 2 * largest * (100 - percent) // (100 + percent)


class Classes:
    """Size classes: `bounds` are their least sizes, `apart` the most that linked sets of a class differ by."""

    def __init__(self, percent: int, limit: int = 1 << 40):
        self.percent, self.bounds, at = percent, [], 1
        while at < limit:
            self.bounds.append(at)
            at = max(at + 1, int(at * CLASS_RATIO))
        self.apart = [most_apart(b - 1, percent) for b in self.bounds[1:]]


def dealt(tokens: np.ndarray, parts: int, keep: int, head: np.uint64) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures of the `keep` parts that hold most of the sorted tokens; empty parts that had to be kept, if any.

    The order of parts (tokens held, then signature) depends on their content alone.
    """
    at = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    found = mix(mix(head + at[starts]) + np.add.reduceat(mix(tokens ^ C), starts))
    if len(found) > keep:
        size = np.diff(np.concatenate([starts, [len(tokens)]]))
        return found[np.lexsort((found, size))[-keep:]], None
    return found, None if len(found) == keep else np.setdiff1d(np.arange(parts, dtype=np.uint64), at[starts])


@np.errstate(over="ignore")
def signatures(own: np.ndarray, classes: Classes) -> np.ndarray:
    """Signatures of a sorted set: any two linked, different sets have one in common.

    Linked sets differ in D parts at most. With D + 1 + E parts they agree in E + 1 or more,
    and each set may leave out its E weakest: were the strongest part in which both agree
    among them, all E + 1 would be. Where empty parts are left even so, the set also enters
    a second dealing for each.
    """
    n, out = len(own), []
    if not n:
        return own
    first = bisect.bisect_right(classes.bounds, n) - 1
    last = bisect.bisect_right(classes.bounds, 100 * n // classes.percent) - 1
    for k in range(first, last + 1):
        keep = classes.apart[k] + 1
        if keep == 1:
            continue
        parts = keep + 1 + int(SPARE * classes.apart[k])
        head = mix(np.uint64(k) * C + A)
        found, empty = dealt(own, parts, keep, head)
        out.append(found)
        if empty is not None:
            other = np.sort(mix(own + B))
            for part in empty:
                again = mix(part * B + head)
                found, void = dealt(other, parts, keep, again)
                out.append(found)
                if void is not None:
                    out.append(mix(mix(again + void) + B))
    return np.unique(np.concatenate(out)) if out else own[:0]


def parity(own: np.ndarray) -> np.ndarray:
    """A bitmap of 2 to 4 bits a shingle: how often each bit is hit, modulo 2.

    Bitmaps differ in no more bits than their sets differ in shingles; halves of a bitmap
    joined by exclusive or are the bitmap of half its size.
    """
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps, folded to so many words."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def may_link(bits: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes x and y, whose bitmaps differ in so many bits, can be linked."""
    return (100 + percent) * bits <= (100 - percent) * (x + y)


def longs(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(longs(np.concatenate(values)) if values else np.zeros(0, np.int64)))


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tokens: the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch, 1_000_000):
                yield pa.record_batch([pa.array(keys, pa.int64()), lists([shingles(t, n) for t in texts])], ["doc_id", "tokens"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, tokens array<long>")


def summaries(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, key (of the set), bitmap, signatures."""
    known = Classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch, 1_000_000):
                own = [shingles(t, n) for t in texts]
                key = [mix(np.array([len(s), s.sum(), mix(s).sum()], np.uint64)).sum() if len(s) else np.uint64(0) for s in own]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array(longs(np.array(key, np.uint64))), lists([parity(s) for s in own]), lists([signatures(s, known) for s in own])], ["doc_id", "size", "key", "bitmap", "signatures"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, size long, key long, bitmap array<long>, signatures array<long>")


def restricted(df: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """Rows of df whose doc_id is in ids, of which there are `count`; broadcast only below a limit."""
    return df.join(F.broadcast(ids) if count <= BROADCAST_ROWS else ids, "doc_id", "left_semi")


def token_sets(docs: DataFrame, found: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """doc_id (here: the key), tokens of the sets in pairs (a, b), read again from one document each."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    needed = stored(ends.join(found, "key").select(F.col("rep").alias("doc_id"), "key"), "needed")
    made = sets(restricted(docs, needed.select("doc_id"), needed.count()), n)
    return stored(made.join(needed, "doc_id").select(F.col("key").alias("doc_id"), "tokens").dropDuplicates(["doc_id"]), "tokens")


def compared(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link. tokens: doc_id, tokens."""
    left = tokens.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = tokens.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = []
            for k in range(batch.num_rows):
                p, q = (c[k].values.to_numpy() for c in (x, y))
                good.append(bool(linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent)))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of the nodes in edges (a, b): the smallest id each reaches.

    Every round hooks each node to its smallest neighbour, follows hooks to their ends and
    contracts the edges to these ends, so that edges within a component are gone after it.
    What many nodes share (a hub, a label) is made distinct before it is looked up, so no
    join meets one key in many rows; nothing but counts comes to the driver.
    """
    rest = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges")
    found: DataFrame | None = None
    while True:
        hooks = stored(rest.union(rest.select("b", "a")).groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{name}-hooks")
        while True:
            ends = stored(hooks.select(F.col("label").alias("node")).distinct().join(hooks, "node").filter("label <> node").select(F.col("node").alias("label"), F.col("label").alias("to")), f"{name}-ends")
            if not ends.limit(1).count():
                break
            hooks = stored(hooks.join(ends, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-hooks")
        found = hooks if found is None else stored(found.join(hooks.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")
        half = rest.join(hooks.withColumnRenamed("node", "a"), "a").filter("label <> b").select(F.col("label").alias("x"), "b").distinct()
        full = half.join(hooks.withColumnRenamed("node", "b"), "b").filter("label <> x")
        rest = stored(full.select(F.greatest("x", "label").alias("a"), F.least("x", "label").alias("b")).distinct(), f"{name}-edges")
        if not rest.limit(1).count():
            return found.withColumnRenamed("label", "component")


def surviving(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs of keys (a, b) whose bitmaps let them link."""
    left, right = (maps.select(F.col("key").alias(k), F.col("size").alias(f"{k}_size"), F.col("bitmap").alias(f"{k}_map")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy() for k in (2, 4))
            bits = np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                p, q = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (3, 5))
                words = min(len(p), len(q))
                bits[k] = np.bitwise_count(folded(p, words) ^ folded(q, words)).sum()
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(may_link(bits, x, y, percent), pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").filter(f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size)")
    return map_arrow(joined.select("a", "b", "a_size", "a_map", "b_size", "b_map"), run, "a long, b long")


def spanning(runs: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between sets of different groups that can link: of each run, a spanning forest.

    runs: run, key, group, size, bitmap, dealt by run and sorted by it. Every set that can
    link with one of another group is in an edge, and such two are in one tree.
    """

    def edges(keys: list, groups: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray]) -> list[tuple[int, int]]:
        words, out = np.array([len(m) for m in maps]), []
        parent = list(range(len(keys)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        for w in np.unique(words).tolist():
            some = np.flatnonzero(words >= w)
            table = np.stack([folded(maps[k], w) for k in some])
            for q in np.flatnonzero(words == w).tolist():
                bits = np.bitwise_count(table ^ maps[q]).sum(1, dtype=np.int64)
                for m in some[may_link(bits, sizes[q], sizes[some], percent) & (groups[some] != groups[q])].tolist():
                    a, b = root(q), root(m)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((keys[q], keys[m]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def work(table: pa.Table) -> pa.RecordBatch:
            number, keys = table.column("run").to_numpy(), table.column("key").to_numpy()
            groups, sizes = table.column("group").to_numpy(), table.column("size").to_numpy()
            held = table.column("bitmap").combine_chunks()
            flat, ends = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy()  # bits of signed numbers are counted without sign
            out: list[tuple[int, int]] = []
            starts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                out += edges(keys[a:b].tolist(), groups[a:b], sizes[a:b], [flat[ends[k] : ends[k + 1]] for k in range(a, b)])
            return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            number = table.column("run").to_numpy()
            cut = int(np.searchsorted(number, number[-1])) if len(number) else 0
            if cut:
                yield work(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield work(rest.combine_chunks())

    return map_arrow(runs.select("run", "key", "group", "size", "bitmap"), run, "a long, b long")


def dealt_blocks(placed: DataFrame, keys: list[str], parts: DataFrame) -> DataFrame:
    """placed with run: every set of a signature goes to each pair of blocks that its own block is in.

    parts: signature, group, held. A group of RUN_SETS sets or more has blocks of its own,
    which do not meet each other, as its sets need no comparison; the others share blocks.
    """
    parts = parts.withColumn("unit", F.when(F.col("held") >= RUN_SETS, F.col("group")).otherwise(F.lit(-1)))
    units = parts.groupBy("signature", "unit").agg(F.ceil(F.sum("held") / RUN_SETS).alias("blocks"))
    each = units.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("signature", "unit", "block")
    left, right = (each.select("signature", F.col("unit").alias(f"unit{k}"), F.col("block").alias(f"block{k}")) for k in (1, 2))
    meet = left.join(right, "signature").filter("unit1 < unit2 or (unit1 = unit2 and block1 < block2)").filter("unit1 = -1 or unit1 <> unit2")
    meet = meet.withColumn("run", F.xxhash64("signature", "unit1", "block1", "unit2", "block2"))
    alone = each.filter("unit = -1").withColumn("run", F.xxhash64("signature", "unit", "block"))
    sides = [meet.select("signature", F.col(f"unit{k}").alias("unit"), F.col(f"block{k}").alias("block"), "run") for k in (1, 2)]
    at = placed.join(parts.select("signature", "group", "unit"), ["signature", "group"]).join(units, ["signature", "unit"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    return at.join(alone.unionByName(sides[0]).unionByName(sides[1]), ["signature", "unit", "block"]).select("run", *keys)


def runs(met: DataFrame, groups: DataFrame, maps: DataFrame, parts: int) -> DataFrame:
    """The sets of signatures that span groups: run, key, group, size, bitmap; many sets of one signature are dealt to pairs of blocks."""
    placed = met.join(groups.select(F.col("node").alias("key"), "component"), "key", "left").select("signature", "key", F.coalesce("component", "key").alias("group"))
    spread = placed.groupBy("signature").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("held")).filter("low < high")
    placed = stored(placed.join(spread.select("signature", "held"), "signature"), "spanning")
    few = placed.filter(F.col("held") <= RUN_SETS).select(F.col("signature").alias("run"), "key", "group")
    many = placed.filter(F.col("held") > RUN_SETS).drop("held")
    if many.limit(1).count():
        held = stored(many.groupBy("signature", "group").agg(F.count(F.lit(1)).alias("held")), "spanning-groups")
        few = few.unionByName(dealt_blocks(many, ["key", "group"], held))
    return few.join(maps, "key").repartition(parts, "run").sortWithinPartitions("run")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the classes of linked documents. percent: 75 or more."""
    if not 75 <= percent <= 100:
        raise ValueError(f"percent must be 75 to 100, not {percent}: below, parts of sets are too many")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = stored(summaries(docs, n, percent), "summaries")
    keys = summary.select("doc_id", "key", "size").groupBy("doc_id").agg(F.max(F.struct("size", "key")).alias("x")).select("doc_id", "x.*")
    found = stored(summary.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("held"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap")), "sets")
    maps = found.select("key", "size", "bitmap")

    # Signatures that more than one distinct set has. One shuffle serves the aggregate and the join.
    total = summary.agg(F.sum(F.size("signatures"))).first()[0] or 0
    postings = summary.select("key", F.explode("signatures").alias("signature")).repartition(max(parts, pieces(total, TASK_POSTINGS)), "signature")
    shared = postings.groupBy("signature").agg(F.min("key").alias("hub"), F.max("key").alias("high")).filter("hub <> high").drop("high")
    met = stored(postings.join(shared.hint("shuffle_hash"), "signature").distinct(), "met")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = stored(surviving(pairs, maps, percent), "pairs")
        return stored(compared(pairs, token_sets(docs, found, pairs, n), percent), "links")

    # Each set meets one hub, that of most of its signatures; then, where groups still differ, one hub of each other group.
    hubs = stored(met.filter("key <> hub").groupBy(F.col("key").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("held")), "hubs")
    links = links_of(hubs.groupBy("a").agg(F.max(F.struct("held", "b")).alias("x")).select("a", "x.b"))
    groups = components(links, "groups")
    own, other = (groups.select(F.col("node").alias(k), F.col("component").alias(f"{k}_group")) for k in "ab")
    apart = hubs.join(own, "a", "left").join(other, "b", "left").withColumn("b_group", F.coalesce("b_group", "b")).filter(F.coalesce("a_group", "a") != F.col("b_group"))
    more = links_of(apart.groupBy("a", "b_group").agg(F.max(F.struct("held", "b")).alias("x")).select("a", "x.b"))
    if more.limit(1).count():
        links = links.union(more)
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "groups")

    # Signatures that still span groups: what can link there meets block by block in the matrix.
    edges = stored(spanning(runs(met, groups, maps, parts), percent).distinct(), "edges")
    if edges.limit(1).count():
        clusters = components(edges, "clusters").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
        placed = clusters.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("group"))
        last = stored(opened(placed, token_sets(docs, found, edges, n), percent), "last-links")
        if last.limit(1).count():
            # A link joins whole groups.
            own, other = (groups.select(F.col("node").alias(k), F.col("component").alias(f"{k}_group")) for k in "ab")
            joined = last.join(own, "a", "left").join(other, "b", "left").select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
            groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(joined), "groups")

    # A component's name is the smallest id of all its documents, copies included.
    placed = stored(found.select("key", "rep", "held").join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", "held", F.coalesce("component", "key").alias("component")), "placed")
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    copies = stored(placed.join(names, "component").select("key", "held", "component_id"), "copies")
    return join_skewed(keys.filter("size > 0"), copies, "key", F.col("held") >= HOT_COPIES).select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(keys.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def blocks(placed: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """placed (doc_id, group, cluster) with size, band, unit, block: blocks of about BLOCK_SHINGLES.

    Linked sets are in one cluster and in one band of sizes or the next. A group that fills
    a block by itself has blocks of its own, as its members need no comparison.
    """
    sized = placed.join(tokens.select("doc_id", F.size("tokens").cast("long").alias("size")), "doc_id").withColumn("band", F.floor(F.log("size") / (1.001 * math.log(100 / percent))))
    groups = sized.groupBy("cluster", "band", "group").agg(F.sum("size").alias("held")).withColumn("unit", F.when(F.col("held") >= BLOCK_SHINGLES, F.col("group")).otherwise(F.lit(-1)))
    units = groups.groupBy("cluster", "band", "unit").agg(F.ceil(F.sum("held") / BLOCK_SHINGLES).alias("blocks"))
    return sized.join(groups.drop("held"), ["cluster", "band", "group"]).join(units, ["cluster", "band", "unit"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).drop("blocks", "size")


def opened(placed: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different groups of one cluster.

    A block's union of shingles bounds what a query can share with any member: a link with
    c common shingles needs 100 * c >= percent * |x|, as the union is no smaller than x.
    Only queries that reach the bound are compared with the block's members.
    """
    rows = stored(blocks(placed, tokens, percent), "blocks")
    own = rows.groupBy("cluster", "band", "unit", "block").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    left = own.select(*(F.col(c).alias(f"{c}1") if c != "cluster" else F.col(c) for c in own.columns))
    right = own.select(*(F.col(c).alias(f"{c}2") if c != "cluster" else F.col(c) for c in own.columns))
    meet = left.join(right, "cluster").filter("band2 - band1 in (0, 1) and (band1 < band2 or unit1 < unit2 or (unit1 = unit2 and block1 <= block2))")
    meet = meet.filter("(unit1 = -1 or unit1 <> unit2) and not (low1 = high1 and low2 = high2 and low1 = low2)")
    meet = stored(meet.select("cluster", *(f"{c}{k}" for k in (1, 2) for c in ("band", "unit", "block"))).withColumn("pair", F.monotonically_increasing_id()), "block-pairs")
    same = F.expr("band1 = band2 and unit1 = unit2 and block1 = block2")
    sides = [meet.select("pair", F.lit(k).alias("side"), same.alias("same"), "cluster", *(F.col(f"{c}{k}").alias(c) for c in ("band", "unit", "block"))) for k in (1, 2)]
    dealt = sides[0].unionByName(sides[1].filter("not same")).join(rows, ["cluster", "band", "unit", "block"]).join(tokens, "doc_id").select("pair", "side", "same", "doc_id", "group", "tokens")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        side, doc, group = (table.column(c).to_pylist() for c in ("side", "doc_id", "group"))
        held = table.column("tokens").combine_chunks()
        values, n = np.unique(held.values.to_numpy(), return_inverse=True)[1], held.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(n)
        queries = [k for k, x in enumerate(side) if x == 1]
        members = queries if table.column("same")[0].as_py() else [k for k, x in enumerate(side) if x == 2]
        if not members:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        first = ends[members[0]] - n[members[0]]
        inside, sizes = values[first : ends[members[-1]]], n[members[0] : members[-1] + 1]
        union = np.zeros(values.max() + 1, bool)
        union[inside] = True
        parent = {g: g for g in group}

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = g = parent[parent[g]]
            return g

        out, mark = [], np.zeros(len(union), bool)
        for q in queries:
            x = values[ends[q] - n[q] : ends[q]]
            if 100 * np.count_nonzero(union[x]) < percent * n[q]:
                continue
            mark[x] = True
            common = np.add.reduceat(mark[inside].astype(np.int64), np.cumsum(sizes) - sizes)
            mark[x] = False
            for k in np.flatnonzero(linked(common, n[q], sizes, percent)):
                p, r = root(group[q]), root(group[members[k]])
                if p != r:
                    parent[max(p, r)] = min(p, r)
                    out.append((doc[q], doc[members[k]]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return dealt.groupBy("pair").applyInArrow(run, "a long, b long")


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that are linked to a document with a smaller id.

    Rows without words stay, and of rows that repeat an id and a text, one does.
    """
    extra = stored(jaccard_components(docs, n, percent).filter("component_id <> doc_id").select("doc_id"), "extra")
    count = extra.count()
    kept = docs.join(F.broadcast(extra) if count <= BROADCAST_ROWS else extra, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
