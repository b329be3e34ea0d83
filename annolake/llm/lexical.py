"""Ranked lexical search over a bit-sliced impact index.

A term's impact in a document is ``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 50 + ((50 * n * N) div L); a
document's score for a query is the sum of the impacts of the query's terms. The index holds,
for each block of documents and each term, the places of its documents and one bitmap a bit
of their impacts. A query adds its terms' slices by bitwise carry arithmetic: three numbers
become two (sum and carry) with five operations on whole slices, and the last two are added
with a rippling carry. Its best documents are found from the most significant slice down.

Blocks are made by the tasks that read the texts, so texts are not shuffled; corpus counts
are sums of what blocks hold. Queries meet blocks in batches of a bounded size, and a block
gives at most k documents a query, of which the k best of all are kept.

Edge cases: a null text or one without terms is not a document of the index (N does not count
it) and, as a query, finds nothing; rows that repeat a doc_id are documents each; rows that
repeat an item_id are one query with the terms of all; equal scores go to the smaller doc_id,
null ids last; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.llm.common import BROADCAST_ROWS, map_arrow, pieces, row_slices, stored

#: A block ends with so many documents, or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 4_000_000
#: About so many (query, term) pairs are a batch.
BATCH_PAIRS = 50_000

#: Everything but digits, letters and what is not ASCII parts terms; A-Z are lowered.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII; only A-Z in lower case."""
    return (text or "").encode().translate(FOLD).split()


#: Bytes of a posting: its document's place in the block (2), its frequency (4), its document's length (4); kept as three arrays, one behind the other.
POSTING = 10


class Block:
    """Documents of a block as they come: their ids, and the number and frequency of each of their terms."""

    def __init__(self) -> None:
        self.ids: list = []
        self.number: dict[bytes, int] = {}
        self.term, self.tf, self.held, self.size = array("q"), array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, found: Counter) -> None:
        number = self.number
        self.ids.append(doc_id)
        self.term.extend([number.setdefault(t, len(number)) for t in found])
        self.tf.extend(found.values())
        self.held.append(len(found))
        self.size.append(found.total())

    def full(self) -> bool:
        return len(self.ids) == BLOCK_DOCS or len(self.term) >= BLOCK_POSTINGS


def list_rows(number: int, block: Block) -> Iterator[pa.RecordBatch]:
    """A row for the documents (term null) and one for each term, with its postings; places are in order of the ids."""
    order = sorted(range(len(block.ids)), key=lambda k: (block.ids[k] is None, block.ids[k] or 0))
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    ids = [block.ids[k] for k in order]
    term, tf, held, size = (np.frombuffer(x, np.int64) for x in (block.term, block.tf, block.held, block.size))
    place = np.repeat(at, held)
    by_term = np.lexsort((place, term))
    ends = np.cumsum(np.bincount(term, minlength=len(block.number)))
    n = np.minimum(np.repeat(size, held)[by_term], 2**32 - 1).astype(np.uint32)
    place, tf = place[by_term].astype(np.uint16), np.minimum(tf[by_term], 2**32 - 1).astype(np.uint32)
    yield pa.record_batch([pa.array([number]), pa.array([None], pa.string()), pa.nulls(1, pa.binary()), pa.array([int(size.sum())]), pa.array([ids], pa.list_(pa.int64()))], NAMES)
    names, starts = list(block.number), ends - np.diff(ends, prepend=0)
    for k in range(0, len(names), 10_000):
        own = [place[p:q].tobytes() + tf[p:q].tobytes() + n[p:q].tobytes() for p, q in zip(starts[k : k + 10_000].tolist(), ends[k : k + 10_000].tolist())]
        yield pa.record_batch([pa.array([number] * len(own)), pa.array([t.decode() for t in names[k : k + 10_000]]), pa.array(own, pa.binary()), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.list_(pa.int64()))], NAMES)


NAMES = ["block", "term", "postings", "length", "ids"]


def posting_lists(docs: DataFrame) -> DataFrame:
    """block, term, postings of every term of a block; the block's documents (ids, and length: their terms in all) in a row without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for part in row_slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = Counter(terms(text))
                    if own:
                        block.add(doc_id, own)
                        if block.full():
                            yield from list_rows(number, block)
                            number, block = number + 1, Block()
        if block.ids:
            yield from list_rows(number, block)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "block long, term string, postings binary, length long, ids array<long>")


def impact_slices(impact: np.ndarray) -> tuple[int, bytes]:
    """How many slices impacts have, and the slices, least significant first, each in whole bytes."""
    count = int(impact.max()).bit_length()
    bits = (impact[None, :] >> np.arange(count)[:, None]) & 1
    return count, np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").tobytes()


def build_index(docs: DataFrame) -> DataFrame:
    """block, term, places (16-bit numbers of documents in the block), slices, bits; a row without a term has the block's ids.

    docs: doc_id, text. Every term of every document is indexed; only a term of weight 0 has no slices, and no row.
    """
    lists = stored(posting_lists(docs), "lists", "zstd")
    total, length = lists.filter("term is null").agg(F.sum(F.size("ids")), F.sum("length")).first()
    total, length = total or 0, length or 1
    counted = lists.filter("term is not null").groupBy("term").agg(F.sum(F.octet_length("postings") / POSTING).cast("long").alias("df"))
    weights = counted.select("term", F.floor(1000 * F.log((2 * total + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).filter("w > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 20_000):
                data = part.column(2).to_pylist()
                held = np.array([len(x) for x in data]) // POSTING
                places = [x[: 2 * h] for x, h in zip(data, held.tolist())]
                tf, n = (np.frombuffer(b"".join(x[(4 * k + 2) * h : (4 * k + 6) * h] for x, h in zip(data, held.tolist())), np.uint32).astype(np.int64) for k in (0, 1))
                m = 50 + (50 * n * total) // length
                impact = np.repeat(part.column(3).to_numpy(), held) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                ends = np.cumsum(held)
                made = [impact_slices(impact[b - h : b]) for h, b in zip(held.tolist(), ends.tolist())]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(places, pa.binary()), pa.array([x for x, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary()), pa.nulls(part.num_rows, pa.list_(pa.int64()))], ["block", "term", "places", "slices", "bits", "ids"])

    sliced = map_arrow(lists.filter("term is not null").select("block", "term", "postings").join(weights, "term").select("block", "term", "postings", "w"), run, "block long, term string, places binary, slices int, bits binary, ids array<long>")
    blocks = lists.filter("term is null").select("block", "term", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("int").alias("slices"), F.lit(None).cast("binary").alias("bits"), "ids")
    return stored(sliced.unionByName(blocks), "impact-index", "zstd")


def spread(places: np.ndarray, slices: int, bits: bytes, docs: int) -> np.ndarray:
    """A term's slices over all places of the block, in 64-bit words: slices x words."""
    own = np.frombuffer(bits, np.uint8).reshape(slices, -1)
    wide = np.zeros((slices, -(-docs // 64) * 64), np.uint8)
    wide[:, places] = np.unpackbits(own, axis=1, count=len(places), bitorder="little")
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def added(numbers: list[np.ndarray]) -> np.ndarray:
    """The sum of bit-sliced numbers: carry-save while there are more than two, then with a rippling carry."""
    width = max(len(x) for x in numbers) + len(numbers).bit_length()
    total = np.zeros((width, numbers[0].shape[1]), np.uint64)
    carry = np.zeros_like(total)
    for x in numbers:
        both = total ^ carry
        made = total & carry
        made[: len(x)] |= both[: len(x)] & x
        both[: len(x)] ^= x
        total, carry[0], carry[1:] = both, 0, made[:-1]
    ripple = np.zeros(total.shape[1], np.uint64)
    for a, b in zip(total, carry):
        both = a ^ b
        made = (a & b) | (both & ripple)
        a[:] = both ^ ripple
        ripple = made
    return total


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k largest numbers above 0, ties to the smaller place: found from the most significant slice down."""
    tied = np.bitwise_or.reduce(total, axis=0)
    sure = np.zeros_like(tied)
    room = k
    for row in total[::-1]:
        more = tied & row
        n = int(np.bitwise_count(more).sum())
        if n > room:
            tied = more
        elif n:
            sure |= more
            room -= n
            tied &= ~row
        if not room:
            break
    at = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    places = np.concatenate([at(sure), at(tied)[:room]]) if room else at(sure)
    bits = (total[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return places, (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(0)


def query_terms(spark: SparkSession, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(batch, no, item_id), (batch, term, items: the numbers of the queries that have it), and the number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            made = [(item, t.decode()) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in sorted(set(terms(text)))]
            yield pa.record_batch([pa.array([x for x, _ in made], pa.int64()), pa.array([x for _, x in made], pa.string())], ["item_id", "term"])

    pairs = stored(map_arrow(queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), run, "item_id long, term string").distinct(), "query-terms")
    batches = pieces(pairs.count(), BATCH_PAIRS)
    pairs = pairs.withColumn("batch", F.pmod(F.xxhash64("item_id"), F.lit(batches)))
    items = stored(pairs.select("batch", "item_id").distinct().withColumn("no", F.row_number().over(Window.partitionBy("batch").orderBy("item_id"))), "items")
    numbered = pairs.join(items, (pairs["batch"] == items["batch"]) & pairs["item_id"].eqNullSafe(items["item_id"])).select(pairs["batch"], "term", "no")
    return items, numbered.groupBy("batch", "term").agg(F.collect_list("no").alias("items")), batches


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of each query. queries: item_id, text."""
    items, wanted, batches = query_terms(index.sparkSession, queries)
    wanted = stored(wanted, "wanted")
    few = wanted.count() <= BROADCAST_ROWS // 10
    lists = index.filter("term is not null").join(F.broadcast(wanted) if few else wanted, "term").select("block", "batch", "places", "slices", "bits", "ids", "items")
    blocks = index.filter("term is null").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)).cast("array<bigint>")))
    both = lists.unionByName(blocks.select("block", "batch", "places", "slices", "bits", "ids", F.lit(None).cast("array<int>").alias("items")))

    def run(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["block"]).to_pylist()
        ids = next(r["ids"] for r in rows if r["items"] is None)
        own: dict[int, list[np.ndarray]] = {}
        for r in rows:
            if r["items"] is not None:
                number = spread(np.frombuffer(r["places"], np.uint16), r["slices"], r["bits"], len(ids))
                for no in r["items"]:
                    own.setdefault(no, []).append(number)
        out: tuple[list, list, list] = ([], [], [])
        for no in list(own):
            places, scores = best(added(own.pop(no)), k)
            out[0].extend([no] * len(places))
            out[1].extend(ids[p] for p in places.tolist())
            out[2].extend(scores.tolist())
        batch = rows[0]["batch"]
        return pa.table([pa.array([batch] * len(out[0]), pa.int64()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["batch", "no", "doc_id", "score"])

    found = both.groupBy("block", "batch").applyInArrow(run, "batch long, no int, doc_id long, score long")
    order = Window.partitionBy("batch", "no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(items, ["batch", "no"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
