"""Dense retrieval by an inverted file: vectors listed by their nearest centroid, a few lists searched a query.

Centroids are fitted (spherical k-means) on a bounded sample, the SAMPLE_ROWS rows with the
smallest hashes of their ids; every vector is listed. The number of lists that a query opens
is measured on that sample: the smallest that holds the wanted share of the exact nearest
neighbours of sampled queries. So data without clusters opens many lists, clustered data few,
and the recall is the same. What is found is scored by exact cosines.

Lists are dealt to blocks of about BLOCK_ROWS vectors and the queries that open a list to
parts, so that neither a hot list nor a hot query makes a large task; a block and a part meet
in one matrix product. `nearest` is the exact way.

Edge cases: null vectors, and those of length 0, of another length than the centroids, or with
null or non-finite components, are in no list and find nothing; ties go to the smaller id;
fewer than k vectors in the opened lists give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that centroids are fitted on at most, rows that recall is measured with at most.
SAMPLE_ROWS, CALIBRATION_ROWS = 20_000, 400
#: Centroids at most: they are sent to every task.
MOST_LISTS = 4096
#: Vectors in a block, queries in a part.
BLOCK_ROWS, PART_ROWS = 8192, 65_536


@dataclass
class Centroids:
    """points: lists x dimensions, of length 1; probes: lists that a query opens."""

    points: np.ndarray
    probes: int


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors are sound, those as unit vectors in double precision); all of the length of the first sound one."""
    sound = np.array([v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors], bool)
    size = next((len(v) for v, ok in zip(vectors, sound) if ok), 0)
    sound &= np.array([v is not None and len(v) == size for v in vectors], bool)
    own = np.array([v for v, ok in zip(vectors, sound) if ok], np.float64).reshape(int(sound.sum()), size)
    own /= np.abs(own).max(1, keepdims=True, initial=1e-300)
    return sound, own / np.sqrt((own * own).sum(1, keepdims=True))


def fitted(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means: centroids of length 1; one that loses all its rows is moved to the row that fits worst."""
    rng = np.random.default_rng(seed)
    points = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = sample @ points.T
        own = near.argmax(1)
        sums = np.zeros_like(points)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-9)
        sums[empty] = sample[np.argsort(near.max(1))[: len(empty)]]
        points = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return points


def calibrated(sample: np.ndarray, points: np.ndarray, k: int, recall: float) -> int:
    """How many lists hold `recall` of the k nearest of sampled queries, over all of these."""
    asked = sample[:CALIBRATION_ROWS]
    own = (sample @ points.T).argmax(1)
    near = np.argsort(-(asked @ sample.T), axis=1)[:, : k + 1]  # itself included
    rank = np.argsort(np.argsort(-(asked @ points.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def centroids(vectors: DataFrame, k: int = 10, recall: float = 0.95, lists: int | None = None) -> Centroids | None:
    """Of vectors (id, vector); None where no vector is sound. lists: the root of their number, unless given."""
    count = vectors.count()
    some = vectors.withColumn("_h", F.xxhash64("id")).orderBy("_h", "id").limit(SAMPLE_ROWS).select("vector")
    sample = unit_rows([r[0] for r in some.collect()])[1]
    if not len(sample):
        return None
    lists = min(lists or max(1, round(math.sqrt(count))), MOST_LISTS, len(sample))
    points = fitted(sample, lists)
    return Centroids(points, calibrated(sample, points, k, recall))


def dealt(df: DataFrame, key: str, known: Centroids, lists: int) -> DataFrame:
    """key, vector (unit) and list: the nearest `lists` centroids of each sound vector, a row each."""
    points = df.sparkSession.sparkContext.broadcast(known.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        size = points.value.shape[1]
        for batch in batches:
            raw = [v if v is not None and len(v) == size else None for v in batch.column(1).to_pylist()]
            sound, own = unit_rows(raw)
            if not len(own):
                continue
            near = own @ points.value.T
            best = np.argpartition(-near, lists - 1, axis=1)[:, :lists] if lists < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
            again = np.repeat(np.arange(len(own)), best.shape[1])
            ids = batch.column(0).filter(pa.array(sound)).take(pa.array(again))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(own[again].ravel()), size).cast(pa.list_(pa.float64()))
            yield pa.record_batch([ids, flat, pa.array(best.ravel().astype(np.int32))], [key, "vector", "list"])

    return df.select(key, "vector").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>, list int")


def index(vectors: DataFrame, known: Centroids) -> DataFrame:
    """id, vector (unit), list: every sound vector, in the list of its nearest centroid. Write it as a table, partitioned by list, to search it again."""
    return dealt(vectors, "id", known, 1)


def search(queries: DataFrame, listed: DataFrame, known: Centroids, k: int, threshold: float = -1.0, probes: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the k nearest in the lists that each query opens. queries: query_id, vector; listed: see `index`."""
    return met(dealt(queries, "query_id", known, min(probes or known.probes, len(known.points))), listed, k, threshold)


def met(opened: DataFrame, listed: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k best of each query over the lists that it opens: blocks of a list's vectors meet parts of its queries, in a matrix product each.

    opened: query_id, vector, list; listed: id, vector, list; unit vectors, of one length in a list.
    """
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    asked = opened.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
    shape = F.broadcast(sizes.join(asked, "list"))  # a row a list, of which there are MOST_LISTS at most
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    rows = listed.join(shape, "list").withColumn("block", own("id", "blocks")).withColumn("part", every("parts")).select("list", "block", "part", "id", "vector")
    asks = opened.join(shape, "list").withColumn("part", own("query_id", "parts")).withColumn("block", every("blocks")).select("list", "block", "part", "query_id", "vector")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = matrix(left), matrix(right)
        ids, asking = left.column("id").combine_chunks(), right.column("query_id").combine_chunks()
        r, c, scores = best_of(q, x, order_of(ids), k, threshold) if len(x) and len(q) else (NONE, NONE, np.zeros(0))
        return pa.table([asking.take(pa.array(r)), ids.take(pa.array(c)), pa.array(scores)], ["query_id", "id", "score"])

    found = rows.groupBy("list", "block", "part").cogroup(asks.groupBy("list", "block", "part")).applyInArrow(run, kinds(opened, listed))
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def kinds(queries: DataFrame, vectors: DataFrame) -> str:
    return ", ".join([*(f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((queries, "query_id"), (vectors, "id"))), "score double"])


def matrix(table: pa.Table) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


NONE = np.zeros(0, np.int64)


def order_of(ids: pa.Array) -> np.ndarray:
    """The place of each id among the ids in order."""
    at = np.empty(len(ids), np.int64)
    at[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return at


def best_of(q: np.ndarray, x: np.ndarray, rank: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k rows of x with the largest products with each query, ties to the smaller rank."""
    out = []
    for a in range(0, len(q), 512):
        scores = np.round(q[a : a + 512] @ x.T, 12)  # so that equal cosines tie, however a product adds up
        best = narrowed(scores, rank, min(k, len(x)))
        kept = np.take_along_axis(scores, best, axis=1)
        r, c = np.nonzero(kept >= threshold)
        out.append((r + a, best[r, c], kept[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out))


def by_length(df: DataFrame, key: str) -> DataFrame:
    """key, vector (unit) and list: sound vectors, listed by their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            for size in sorted({len(v) for v in vectors if v}):
                sound, own = unit_rows([v if v and len(v) == size else None for v in vectors])
                if len(own):
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), size).cast(pa.list_(pa.float64()))
                    yield pa.record_batch([batch.column(0).filter(pa.array(sound)), flat, pa.array(np.full(len(own), size, np.int32))], [key, "vector", "list"])

    return df.select(key, "vector").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>, list int")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = -1.0, most_bytes: int = 64_000_000) -> DataFrame:
    """query_id, id, score, rank: exactly the k nearest by cosine similarity, ties to the smaller id.

    Queries of up to `most_bytes` in all are sent to the tasks, each of which keeps the k best of its vectors a
    query; more meet the vectors by a shuffle, block by block. Vectors of different lengths don't meet.
    """
    asks, rows = by_length(queries, "query_id"), by_length(vectors, "id")
    held = queries.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    if held > most_bytes:
        return met(asks, rows, k, threshold)
    table = asks.toArrow()
    sent = {size: table.filter(pc.equal(table.column("list"), size)).combine_chunks() for size in table.column("list").unique().to_pylist()}
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast({size: (t.column("query_id").combine_chunks(), matrix(t)) for size, t in sent.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kept: dict[int, pa.Table] = {}
        for batch in batches:
            for size in batch.column(2).unique().to_pylist():
                if size not in shared.value:
                    continue
                own = pa.Table.from_batches([batch]).filter(pc.equal(batch.column(2), size))
                ids, (asking, q) = own.column(0).combine_chunks(), shared.value[size]
                r, c, scores = best_of(q, matrix(own), order_of(ids), k, threshold)
                more = pa.table([pa.array(r), ids.take(pa.array(c)), pa.array(scores)], ["no", "id", "score"])
                both = pa.concat_tables([kept[size], more]) if size in kept else more
                both = both.sort_by([("no", "ascending"), ("score", "descending"), ("id", "ascending")])
                no = both.column("no").to_numpy()
                kept[size] = both.filter(pa.array(np.arange(len(no)) - np.searchsorted(no, no) < k))
        for size, table in kept.items():
            table = table.combine_chunks()
            yield pa.record_batch([shared.value[size][0].take(table.column("no").combine_chunks()), *(table.column(c).combine_chunks() for c in ("id", "score"))], ["query_id", "id", "score"])

    return ranked(rows.mapInArrow(run, kinds(asks, rows)), k)


def nearest_of_few(queries: DataFrame, few: DataFrame, k: int, threshold: float = -1.0, most: int = 65_536) -> DataFrame:
    """As `nearest`, where the vectors are few: they are sent to the tasks, and queries, however many, are read once. More than `most` go to `nearest`."""
    rows = by_length(few, "id")
    table = rows.limit(most + 1).toArrow()
    if table.num_rows > most:
        return nearest(queries, few, k, threshold)
    sent = {size: table.filter(pc.equal(table.column("list"), size)).combine_chunks() for size in table.column("list").unique().to_pylist()}
    shared = queries.sparkSession.sparkContext.broadcast({size: (t.column("id").combine_chunks(), matrix(t)) for size, t in sent.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for size in batch.column(2).unique().to_pylist():
                if size in shared.value:
                    own = pa.Table.from_batches([batch]).filter(pc.equal(batch.column(2), size))
                    ids, x = shared.value[size]
                    r, c, scores = best_of(matrix(own), x, order_of(ids), k, threshold)
                    yield pa.record_batch([own.column(0).combine_chunks().take(pa.array(r)), ids.take(pa.array(c)), pa.array(scores)], ["query_id", "id", "score"])

    asks = by_length(queries, "query_id")
    return ranked(asks.mapInArrow(run, kinds(asks, rows)), k)


def narrowed(scores: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to the smaller rank: only what reaches the k-th score is sorted."""
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), np.int64)
    for r, row in enumerate(scores >= least):
        some = np.flatnonzero(row)
        out[r] = some[np.lexsort((rank[some], -scores[r, some]))[:k]]
    return out


def nearest_listed(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = -1.0, recall: float = 0.95, lists: int | None = None) -> DataFrame:
    """As `nearest`, through an inverted file that is fitted here; nothing is found where no vector is sound."""
    known = centroids(vectors, k, recall, lists)
    if known is None:
        return queries.join(vectors.select("id"), F.lit(False)).select("query_id", "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return search(queries, index(vectors, known), known, k, threshold)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of exact (query_id, id) that found has."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
