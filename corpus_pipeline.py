"""The corpus pipeline: from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Toxic documents go; of each group of near copies (five-word shingles,
Jaccard similarity of 0.8 or more) the smallest id stays; secrets are masked; sources are
mixed so that none is read more than twice and every document at least once (a document
read twice is two rows); and what results is packed into sequences of 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm import mixing, ngram_join, packing, secrets, toxicity
from annolake.llm.common import read, stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.distinct_documents(docs, n=5, percent=80)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = secrets.redact(docs)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, docs.columns, repetition_limit=2.0).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 1024)


STAGES = [("toxicity", toxic), ("ngram_jaccard", near_copies), ("secrets", masked_secrets), ("mixing", mixed), ("packing", packed)]
#: SQL cannot tokenise or learn a lexicon; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
