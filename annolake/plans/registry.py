"""Registered queries: a function (spark, sf_dir) each, and SQL for the same rows where it can be given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.plans.oracle import PREFIX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Inputs that are dealt by paper already meet by paper and place as they lie; Python is given some MB of texts at once, not ten thousand of them.
PLANNED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def planned(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one and PLANNED, which queries are planned with; the given one stays as it is."""
    own = spark.newSession()
    for key, value in {**{k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.") and own.conf.isModifiable(k)}, **PLANNED}.items():
        own.conf.set(key, value)
    return own


def query(sql: str | None = None, bare: bool = False):
    """Registers a function by its name. sql: what follows the derived collections (bare: all of the SQL)."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = function(planned(spark), sf_dir)
            return made.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in made.dtypes])

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql:
            SQL[function.__name__] = sql if bare else PREFIX + sql
        return run

    return add
