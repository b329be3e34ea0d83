"""Best-fit packing of tokenised documents by hierarchical residual packing.

Documents are tokenised with a public byte-level vocabulary, long ones are cut into
pieces of at most `capacity` tokens, and pieces are packed into sequences:

1. the pieces are dealt into groups by a hash of their row; each group packs its own
   by best fit, longest first;
2. bins with at most `slack` free tokens are emitted; all others become items;
3. groups merge `fan` to one and pack these items again, up to one root group, which
   emits all it has.

A group holds about `group_rows` pieces. Where a merged group would hold more than twice
as many (the input has more pieces than fit each other, such as long ones alone), items are
dealt anew into as many groups as that takes, by a hash of bin and round, so each round
meets other partners. Rounds without a merge go on until one makes less than a share `gain`
of the bins vanish; the last emits all. So no group grows with the input and no bin is
emitted half empty before a whole round over random partners could not fill it.

Edge cases: a null or empty text is the end token alone (one piece of length 1); a text
of any length is cut, never truncated; repeated rows are packed once per row; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import Cache, map_arrow, pieces, slices, stored

#: Fixed value: the word pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", node long, bin long, offset long, fill long, done boolean"


@cache
def byte_bpe(vocabulary: str) -> tuple[regex.Pattern, Cache]:
    """Word pattern, and ids of each word as little-endian unsigned 32-bit numbers."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return regex.compile(PATTERN), Cache(lambda word: np.array(encode(word.encode()), "<u4").tobytes(), 60_000)


def encode(text: str, vocabulary: str) -> bytes:
    """The ids of a text, four bytes each; words are encoded once and remembered."""
    pattern, ids = byte_bpe(vocabulary)
    return b"".join(map(ids.__getitem__, pattern.findall(text)))


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces; the first is the short one."""
    start, size = 0, length % capacity or min(length, capacity)
    while start < length:
        yield start, size
        start, size = start + size, capacity


def tokenised(docs: DataFrame, vocabulary: str, capacity: int = 1024) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for keys, texts in slices(batch, 2_000_000):
                rows: list[tuple] = []
                for key, text in zip(keys, texts):
                    data = encode(text, vocabulary) + end
                    rows += [(key, k, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])) for k, (at, size) in enumerate(cut(len(data) // 4, capacity))]
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select("doc_id", "text"), run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of items in descending order: bin and offset of each item, fill of each bin.

    Open bins are kept by free space; a bit mask finds the tightest that still fits.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            own = by_free[free]
            chosen = own.pop()
            if not own:
                mask ^= 1 << free
            offsets[item] = fill[chosen]
            fill[chosen] += size
        else:
            chosen, free = len(fill), capacity
            fill.append(size)
        bins[item] = chosen
        if free > size:
            by_free[free - size].append(chosen)
            mask |= 1 << (free - size)
    return bins, offsets, np.array(fill, np.int64)


def packed(parts: DataFrame, capacity: int = 1024, slack: int = 8, group_rows: int = 40_000, fan: int = 4, gain: float = 0.01) -> DataFrame:
    """parts (PIECES) with sequence_id and offset."""
    parts = stored(parts, "pieces")
    groups = pieces(parts.count(), group_rows)
    level, found = 0, []

    def packer(last: bool, level: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: pack(table, last, level)

    def pack(table: pa.Table, last: bool, level: int) -> pa.Table:
        doc, piece, own, before = (table.column(c).to_numpy() for c in ("doc_id", "piece", "bin", "offset"))
        order = np.lexsort((before, piece, doc, own))
        table, own, before = table.take(order), own[order], before[order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        item = np.cumsum(first) - 1
        bins, offsets, fill = best_fit(table.column("fill").to_numpy()[first], capacity)
        done = np.full(len(fill), last) | (fill >= capacity - slack)
        node = int(table.column("node")[0].as_py())
        bin_of = bins[item]
        columns = {c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "node")}
        columns |= {"bin": pa.array((level << 53) + (node << 28) + bin_of), "offset": pa.array(before + offsets[item]), "fill": pa.array(fill[bin_of]), "done": pa.array(done[bin_of])}
        return pa.table(columns)

    # Row numbers keep repeated rows apart, also in their groups: each row is an item of its own.
    items = parts.withColumns({"bin": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "fill": F.col("length"), "done": F.lit(False)})
    items = items.withColumn("node", F.pmod(F.xxhash64("doc_id", "piece", "start", "bin"), F.lit(groups)))
    last = groups == 1
    bins: float = math.inf
    while True:
        made = stored(items.groupBy("node").applyInArrow(packer(last, level), PACKED), f"packed{level}")
        found.append(made.filter("done"))
        if last:
            break
        level += 1
        # Every bin has one piece at offset 0.
        items = made.filter("not done")
        rows, held = items.agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
        if not held:
            break
        tree, least = pieces(groups, fan), pieces(rows, 2 * group_rows)
        node = F.floor(F.col("node") / fan) if tree >= least else F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(least))
        last = max(tree, least) == 1 or (least >= groups and held > (1 - gain) * bins)
        groups, bins = max(tree, least), held
        items = items.withColumn("node", node)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, **options) -> DataFrame:
    return packed(tokenised(docs, vocabulary, capacity), capacity, **options)
