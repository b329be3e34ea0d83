"""Queries that drew their relations twice, as often as they read them."""

import pytest

from annolake.operators import records
from annolake.plans import evaluation, models, registry  # noqa: F401  they register their queries
from pyspark.sql import functions as F


def test_failing_counts_as_removed_does(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (2, "x"), (3, "y")], "g int, v string")
    passes = F.coalesce(F.col("v") == "x", F.lit(False))
    both = [sorted(map(tuple, d.select("g", "n", "removed").collect())) for d in (records.failing(a, passes, "g"), records.removed(a, a.filter(passes), "g"))]
    assert both[0] == both[1] == [(1, 2, 1), (2, 2, 1), (3, 1, 1)]
    assert records.failing(a, passes).first().asDict() == {"n": 5, "removed": 3}


@pytest.mark.parametrize("name, most", [("illegal_mention_relations", 3), ("illegal_concept_relations", 3), ("ens_re_mixed", 1)])
def test_relations_are_drawn_once(spark, name, most):
    """Relations once and, where texts of their ends are needed, gold entities once for each end."""
    made = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == most
