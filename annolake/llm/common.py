"""What the corpus operators share: reading, words, shared scratch tables, bounded caches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def words(text: str | None, lower: bool = False) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; lower: with A-Z, and no other letters, in lower case.

    bytes.split() parts at exactly these characters, and bytes.lower() lowers A-Z only; both
    are several times faster than a pattern.
    """
    own = word_bytes(text, lower)
    return b"\n".join(own).decode().split("\n") if own else []


def word_bytes(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_own_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own, removed at exit, only where none is set and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_scratch:
        path = tempfile.mkdtemp(prefix="annolake-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_scratch[key] = f"file://{path}"
    return _own_scratch[key]


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/annolake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo the number of folds (a null id: fold 0 of crc32(''))."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


class Cache(dict):
    """A dict that computes missing values and starts again when it holds `limit` of them.

    A process keeps it from task to task as long as these are of one module (see `enter`).
    """

    def __init__(self, make: Callable, limit: int = 250_000):
        super().__init__()
        self.make, self.limit = make, limit
        _caches.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


_caches: list[weakref.ref[Cache]] = []
_entered: list[str] = [""]


def enter(module: str) -> None:
    """Empties this process's caches when a task of another module begins: workers live on from stage to stage, and what each left would add up."""
    if _entered[0] != module:
        _entered[0] = module
        _caches[:] = [c for c in _caches if c() is not None]
        for cache in _caches:
            cache().clear()


def word_hash(word: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def release() -> None:
    """Gives freed memory back to the system: idle workers keep what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(function.__module__)
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def row_slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def slices(batch: pa.RecordBatch, chars: int = 8_000_000, empty: str | bytes = "") -> Iterator[tuple[list, list]]:
    """(ids, texts) of about `chars` characters, of a batch whose first two columns are id and text; null texts become `empty`. empty: of bytes, if the texts are."""
    ids: list = []
    texts: list = []
    size = 0
    for part in row_slices(batch):
        ids += part.column(0).to_pylist()
        more = [t or empty for t in part.column(1).to_pylist()]
        size += sum(map(len, more))
        texts += more
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


#: More rows than this are not broadcast.
BROADCAST_ROWS = 1_000_000


def join_skewed(left: DataFrame, right: DataFrame, key: str, hot: Column) -> DataFrame:
    """left with the columns of right, which has one row a key; left's rows without one go.

    Rows of right for which `hot` holds have many rows on the left: they are broadcast (where
    no more than BROADCAST_ROWS), so that no task gets all of a key. right is read twice.
    """
    some = right.filter(hot)
    if not 0 < some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(right, key)
    names = [c for c in right.columns if c != key]
    marked = left.join(F.broadcast(some.withColumn("_hot", F.lit(True))), key, "left")
    rest = marked.filter("_hot is null").drop(*names, "_hot").join(right.filter(~hot), key)
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def pieces(total: float, each: float, least: int = 1) -> int:
    """How many groups of about `each` rows hold `total` rows."""
    return max(least, math.ceil(total / each))
