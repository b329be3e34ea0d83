"""Resumable processing of papers as a stream: each run takes what is new and then ends.

Which papers were seen is keyed state of the stream, kept in its checkpoint, so a batch looks
up its own keys only and never reads the results. Results of a batch are a folder of their own,
written anew whenever the batch is run again: what fails between writing and the commit of the
batch is replaced, not doubled. For many keys, set the RocksDB state store
(spark.sql.streaming.stateStore.providerClass), which keeps them on disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def remaining(papers: DataFrame, done: DataFrame, key: str = "paper_id") -> DataFrame:
    """Papers whose key is not done; those without a key can't be told apart and remain."""
    return papers.join(done.select(key).distinct(), key, "left_anti")


def resumed(papers: DataFrame, done: DataFrame, work: Callable[[DataFrame], DataFrame], key: str = "paper_id") -> DataFrame:
    """All results: those that are done as they are, and work on what remains; columns by name."""
    return done.unionByName(work(remaining(papers, done, key)), allowMissingColumns=True)


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "paper_id", done: DataFrame | None = None) -> StreamingQuery:
    """Reads JSON lines that have come since the last run, applies `work` to papers not seen before, and writes a folder `batch=<number>` of parquet a batch.

    Of rows with one key, in a batch or over all of them, one counts; bad lines are left out. done: keys that earlier
    work has results for, as of a stored checkpoint. Read results with `results`.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch if done is None else remaining(batch, done, key)
        work(fresh).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    stream = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(source).dropDuplicates([key])
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def results(spark: SparkSession, sink: str) -> DataFrame:
    """What all batches gave."""
    return spark.read.option("basePath", sink).parquet(sink).drop("batch")
