"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from annolake.plans import evaluation, linking_relations, models, registry, text  # noqa: F401  they register their queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, values):
    def plain(x):
        return float(f"{x:.6g}") if isinstance(x, float) and not math.isnan(x) else x

    return sorted((tuple(repr(plain(r[columns.index(c)])) for c in sorted(columns)) for r in values))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    made = registry.QUERIES[name](spark, SF)
    found = rows(made.columns, [tuple(r) for r in made.collect()])
    if name in registry.SQL:
        known = duck.execute(registry.SQL[name])
        columns = [d[0] for d in known.description]
        assert sorted(columns) == sorted(made.columns)
        assert found == rows(columns, known.fetchall())
    assert found
