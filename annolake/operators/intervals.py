"""Places and intervals on one line, met by a sweep instead of all pairs of a section.

Rows with a position (points) ask about rows with another (steps): both are put in one order
by position, and a running aggregate of the steps so far answers each point. A sweep costs a
sort of points and steps, whatever their number in one group; Spark keeps a group's rows in
buffers that spill, and running values in one row.

The operators on tokens, sentences and entities are compositions of it:

- the last step at or before a point (tokens, sentences: they don't overlap),
- the first step after a point, as each step is entered at the place of the one before it,
- whether any interval holds a point, as the largest end of those that have begun.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = ["paper_id", "location"]
#: Before every position.
START = -(2**31)


def swept(points: DataFrame, at: str | Column, steps: DataFrame, since: str | Column, values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """points with running aggregates of all steps of the same group with since <= at; null before the first.

    values: new column name to an aggregate over columns of steps, such as F.max("end_idx").
    """
    by = by or SECTION
    place = lambda x: (F.col(x) if isinstance(x, str) else x).cast("long").alias("_at")
    own, rest = [c for c in steps.columns if c not in by], [c for c in points.columns if c not in by]
    asked = points.select(*by, place(at), F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"))
    known = steps.select(*by, place(since), F.lit(0).alias("_kind"), *own)
    both = known.unionByName(asked, allowMissingColumns=True)
    so_far = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    made = both.select(*by, "_kind", "_row", *(v.over(so_far).alias(c) for c, v in values.items()))
    return made.filter("_kind = 1").select(*by, *(F.col("_row")[c].alias(c) for c in rest), *values)


def at_or_before(points: DataFrame, at: str | Column, steps: DataFrame, since: str, take: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """points with values of the last step with since <= at. take: new column name to a column of steps."""
    some = steps.select(*(by or SECTION), F.col(since).alias("_since"), *(F.col(c).alias(f"_{n}") for n, c in take.items()), F.lit(True).alias("_is"))
    step = F.struct("_is", *(F.col(f"_{n}") for n in take))
    made = swept(points, at, some, "_since", {"_step": F.last(F.when(F.col("_is"), step), ignorenulls=True)}, by)
    return made.select(*(c for c in made.columns if c != "_step"), *(F.col("_step")[f"_{n}"].alias(n) for n in take))


def first_after(points: DataFrame, at: str | Column, steps: DataFrame, since: str, take: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """points with values of the first step with since > at: each step is entered where the one before it stands."""
    order = Window.partitionBy(*(by or SECTION)).orderBy(since)
    moved = steps.withColumns({"_before": F.coalesce(F.lag(since).over(order), F.lit(START)), "_own": F.col(since)})
    made = at_or_before(points.withColumn("_asked", F.col(at) if isinstance(at, str) else at), "_asked", moved, "_before", {**take, "_own": "_own"}, by)
    return made.withColumns({n: F.when(F.col("_own") > F.col("_asked"), F.col(n)) for n in take}).drop("_own", "_asked")


def held(points: DataFrame, at: str | Column, intervals: DataFrame, start: str | Column, end: str, name: str, by: list[str] | None = None) -> DataFrame:
    """points with `name`: the largest end of the intervals with start <= at (inclusive); null if none has begun."""
    some = intervals.select(*(by or SECTION), (F.col(start) if isinstance(start, str) else start).alias("_start"), F.col(end).alias("_end"))
    return swept(points, at, some, "_start", {name: F.max("_end")}, by)


def inside(intervals: DataFrame, start: str, end: str, steps: DataFrame, take: str, by: list[str] | None = None) -> DataFrame:
    """intervals with `first` and `last`: the values of the first and the last step (s, e; apart, e exclusive) that lie wholly in them.

    Intervals that hold no step go. Of steps in order of s, ends are in order too.
    """
    some = first_after(intervals, F.col(start) - 1, steps, "s", {"first": take, "_s": "s"}, by)
    some = at_or_before(some, F.col(end) + 1, steps, "e", {"last": take, "_e": "e"}, by)
    return some.filter("_s < _e").drop("_s", "_e")


def touched(intervals: DataFrame, start: str, end: str, steps: DataFrame, take: str, by: list[str] | None = None) -> DataFrame:
    """intervals with `first` and `last`: the values of the first and the last step that share a character with them."""
    some = first_after(intervals, F.col(start), steps, "e", {"first": take, "_s": "s"}, by)
    some = at_or_before(some, F.col(end), steps, "s", {"last": take, "_e": "e"}, by)
    return some.filter("_s < _e").drop("_s", "_e")
