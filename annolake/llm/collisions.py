"""Near copies among embeddings by collision counting on one-dimensional projections.

Two vectors of one label link when their cosine is `least` or more, so as unit vectors they
are no further apart than ``d = sqrt(2 - 2 * least)``. On a projection on a random normal
direction they then differ by a normal value of deviation d at most; unlike vectors, whose
distance is near sqrt(2), by one several times larger.

1. *Cells.* All pairs collide on some projection, so counting over a whole label would be
   quadratic. Each vector is therefore entered in several tables of cells, a cell being the
   rounded values of a few projections. How many of them, and how many tables, follows from
   the largest label: more rows make cells finer, and tables are added until a linked pair at
   the threshold shares a cell of one table with probability CELL_RECALL.
2. *Counting.* Within a cell, vectors are sorted on each of PROJECTIONS other projections;
   each asks which lie in the window of WINDOW deviations around it, and these collisions are
   counted for each pair. The count that a pair needs is the largest that a linked pair at
   the threshold reaches with probability COUNT_RECALL (a binomial tail).
3. *Verifying.* Pairs that pass are verified by their cosine in double precision. A pair that
   shares a cell of several tables counts in the first of them only.

Equal vectors are counted once, with their number of copies. A large cell is dealt to blocks,
each pair of which is one run of rows, so no task holds a cell; what leaves a run is a sum a
vector and a spanning forest of its links, never its pairs.

Edge cases: a null label, and a null, empty or zero vector or one with null, NaN or infinite
components links with nothing; vectors of different lengths do not link; rows that repeat a
vec_id are one vector (of different ones the least label and vector counts); null ids give a
row each, which links with nothing and is kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import join_skewed, map_arrow, pieces, stored
from annolake.llm.ngram_join import components

PROJECTIONS, WINDOW, COUNT_RECALL = 24, 1.5, 0.999
#: Width of a cell in units of the linked distance, wanted number of unlike vectors in a cell, recall of the tables.
CELL_WIDTH, CELL_ROWS, CELL_RECALL = 7.5, 8, 0.998
#: Cells of more vectors are dealt to blocks of about so many.
BLOCK_ROWS = 1024
#: A vector or cell with so many copies or members is joined by a broadcast.
HOT = 4096


def tail(n: int, least: int, p: float) -> float:
    """The probability of `least` or more of n."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


def within(width: float) -> float:
    """The probability that a standard normal value lies within +-width."""
    return math.erf(width / math.sqrt(2))


def needed_count(n: int = PROJECTIONS, window: float = WINDOW, recall: float = COUNT_RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall`."""
    return max(k for k in range(n + 1) if tail(n, k, within(window)) >= recall)


def same_cell(width: float) -> float:
    """The probability that two values, apart by a standard normal value, are in one of the cells of a width at a random offset."""
    return within(width) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


def shape(rows: int, distance: float) -> tuple[int, int]:
    """(values of a cell, tables) for a largest label of so many rows."""
    near, far = same_cell(CELL_WIDTH), same_cell(CELL_WIDTH * distance / math.sqrt(2))
    values = max(2, math.ceil(math.log(max(rows / CELL_ROWS, 1)) / -math.log(far)))
    return values, max(1, math.ceil(math.log(1 - CELL_RECALL) / math.log(1 - near**values)))


def units(vectors: list[list[float]]) -> np.ndarray:
    """Vectors of one length, each of length 1; scaled by the largest component first, so that squares stay finite."""
    v = np.array(vectors, np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key), and key, rep (the smallest id), label, v, held of the distinct vectors that can link."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null")
    repeated = rows.groupBy("vec_id").count().filter("count > 1").limit(1).count()
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*") if repeated else rows
    sound = F.expr("label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157e308) and exists(v, x -> x <> 0)")
    keyed = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.struct("label", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    found = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("held"))
    return keyed.select("vec_id", "key"), stored(found, "vectors")


def cells(found: DataFrame, values: int, tables: int, distance: float) -> DataFrame:
    """rep, cells: the vector's cell in each table; label and length of the vector are part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            size = np.array([len(v) for v in vectors])
            for n in np.unique(size).tolist():
                some = np.flatnonzero(size == n)
                rng = np.random.default_rng([17, n])
                place = units([vectors[k] for k in some]) @ rng.normal(size=(n, values * tables)) + rng.uniform(0, CELL_WIDTH * distance, values * tables)
                place = np.floor(place / (CELL_WIDTH * distance)).astype(np.int64).reshape(len(some), tables, values)
                picked = batch.take(pa.array(some))
                yield pa.record_batch([picked.column(0), picked.column(1), pa.array([n] * len(some), pa.int64()), pa.array(place.tolist(), pa.list_(pa.list_(pa.int64())))], ["rep", "label", "n", "place"])

    placed = map_arrow(found.select("rep", "label", "v"), run, "rep long, label string, n long, place array<array<long>>")
    return stored(placed.select("rep", F.transform("place", lambda x, k: F.xxhash64("label", "n", k, x)).alias("cells")), "cells")


def runs(placed: DataFrame) -> DataFrame:
    """rep, table, run, side of the vectors that share a cell: side 0 meets side 1, or itself where no row has side 1."""
    each = placed.select("rep", F.posexplode("cells").alias("table", "cell"))
    held = stored(each.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "cell-sizes")
    met = join_skewed(each, held, "cell", F.col("members") >= HOT).withColumn("blocks", F.ceil(F.col("members") / BLOCK_ROWS))
    alone = met.filter("blocks = 1").select("rep", "table", F.col("cell").alias("run"), F.lit(0).alias("side"))
    many = met.filter("blocks > 1").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return alone.unionByName(many.select("rep", "table", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("run"), (F.col("own") > F.col("other")).cast("int").alias("side")))


def sparse_counts(p: np.ndarray, group: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < k) of rows of one group whose windows collide on `least` projections or more; groups are small."""
    n, span = len(p), 4 * np.abs(p).max() + 4 * window
    held = []
    for j in range(p.shape[1]):
        key = p[:, j] + group * span  # groups are sorted side by side
        order = np.argsort(key)
        key = key[order]
        reach = np.searchsorted(key, key + window, "right") - np.arange(n) - 1
        first = np.repeat(np.arange(n), reach)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(reach) - reach, reach)
        a, b = order[first], order[second]
        held.append(np.minimum(a, b) * n + np.maximum(a, b))
    pair, count = np.unique(np.concatenate(held), return_counts=True)
    pair = pair[count >= least]
    return pair // n, pair % n


def dense_counts(p: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one group: on each projection, a row's window is a range of the sorted rows."""
    n = len(p)
    count, at = np.zeros((n, n), np.uint8), np.arange(n)
    for j in range(p.shape[1]):
        order = np.argsort(p[:, j])
        key = p[order, j]
        low, high = np.searchsorted(key, p[:, j] - window, "left"), np.searchsorted(key, p[:, j] + window, "right")
        rank = np.empty(n, np.int64)
        rank[order] = at
        count += (rank[None, :] >= low[:, None]) & (rank[None, :] < high[:, None])
    i, k = np.nonzero(count >= least)
    return i[i < k], k[i < k]


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of edges (a, b)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(a, b):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def links(found: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """a, b, n: with b, an edge of a run's forest; without, n vectors (copies counted) that a links with."""
    distance, needed = math.sqrt(2 - 2 * least), needed_count()
    window = WINDOW * distance
    payload = found.select("rep", "v", "held").join(placed, "rep")
    dealt = runs(placed).join(payload, "rep").select("run", "side", "table", "rep", "held", "cells", "v")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(max(parts, pieces(found.count(), 50_000)), "run").sortWithinPartitions("run")

    def work(table: pa.Table) -> pa.RecordBatch:
        side, number, reps, held = (table.column(c).to_numpy() for c in ("side", "table", "rep", "held"))
        codes = np.array(table.column("cells").to_pylist(), np.int64)
        runs_, size = np.unique(table.column("run").to_numpy(), return_inverse=True)[1], np.array(table.column("v").combine_chunks().value_lengths())
        found: list[tuple[np.ndarray, np.ndarray]] = []
        v = np.zeros((len(reps), size.max()))
        p = np.zeros((len(reps), PROJECTIONS))
        raw = table.column("v").to_pylist()
        for n in np.unique(size).tolist():
            some = np.flatnonzero(size == n)
            v[some, :n] = units([raw[k] for k in some])
            p[some] = v[some, :n] @ np.random.default_rng([23, n]).normal(size=(n, PROJECTIONS))
        del raw
        members = np.bincount(runs_)
        small = np.flatnonzero(members[runs_] <= 64)
        for k in range(0, len(small), 4096):  # a run that is cut here is counted once more below
            cut = small[(runs_[small] >= runs_[small[k]]) & (runs_[small] <= runs_[small[min(k + 4096, len(small)) - 1]])]
            a, b = sparse_counts(p[cut], runs_[cut], window, needed)
            found.append((cut[a], cut[b]))
        for r in np.flatnonzero(members > 64).tolist():
            own = np.flatnonzero(runs_ == r)
            a, b = dense_counts(p[own], window, needed)
            found.append((own[a], own[b]))
        pairs = np.unique(np.concatenate([np.minimum(a, b) * len(reps) + np.maximum(a, b) for a, b in found]))
        pairs = np.stack([pairs // len(reps), pairs % len(reps)], 1)
        two = np.isin(runs_, runs_[side == 1])
        good = np.zeros(len(pairs), bool)
        for k in range(0, len(pairs), 50_000):
            a, b = pairs[k : k + 50_000].T
            earlier = ((codes[a] == codes[b]) & (np.arange(codes.shape[1]) < number[a, None])).any(1)
            near = np.einsum("ij,ij->i", v[a], v[b]) >= least
            good[k : k + 50_000] = near & ~earlier & (~two[a] | (side[a] != side[b]))
        a, b = pairs[good].T
        sums = np.bincount(a, held[b], len(reps)) + np.bincount(b, held[a], len(reps))
        some = np.flatnonzero(sums)
        edges = forest(reps[a].tolist(), reps[b].tolist())
        left, right = [*reps[some].tolist(), *(x for x, _ in edges)], [*[None] * len(some), *(y for _, y in edges)]
        return pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array([*sums[some].astype(np.int64).tolist(), *[0] * len(edges)], pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
            number = table.column("run").to_numpy()
            cut = int(np.flatnonzero(number == number[-1])[0]) if len(number) else 0
            if cut:
                yield work(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield work(rest.combine_chunks())

    return map_arrow(dealt, run, "a long, b long, n long")


def near_copies(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, embedding, label). least: above 0.5, below 1."""
    if not 0.5 < least < 1:
        raise ValueError(f"least must be above 0.5 and below 1, not {least}")
    distance = math.sqrt(2 - 2 * least)
    rows, found = distinct_vectors(vectors)
    largest = found.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    made = stored(links(found, cells(found, *shape(largest, distance), distance), least), "links")
    sums = made.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(made.filter("b is not null").select("a", "b"), "vector-groups").withColumnRenamed("node", "rep")
    known = found.select("key", "rep", "held").join(sums, "rep", "left").join(groups, "rep", "left")
    known = stored(known.select("key", "held", (F.col("held") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "linked")
    able = join_skewed(rows.filter("key is not null"), known, "key", F.col("held") >= HOT).select("vec_id", "n_links", "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    unnamed = vectors.filter("vec_id is null").select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return able.unionByName(alone).unionByName(unnamed).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
