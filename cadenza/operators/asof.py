"""Joins in time of two flat tables: what came before each query, and what lies in its interval.

Both tables are cut into bins of a key's time. Within a bin rows meet by an equal (key, bin); what earlier bins
know is carried over by sums over a key's bins, of which there are few. So no pair of rows is tested that does not share a bin,
no task holds a whole key, and a key with a third of all rows is as many tasks as it has bins.

Where keys are bounded, as a text's turns are, bins are not needed: without a width both tables are one sequence by key and time, in which facts are
known as they pass. That keeps tables that are dealt by a part of the key where they are: no row of them is shuffled or made twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(time: Column, width: int) -> Column:
    return F.floor(time / F.lit(width)).cast("long")


def _sequence(queries: DataFrame, facts: DataFrame, by: list[str], time: str, fact_time: str, fact: Column) -> DataFrame:
    """Facts (_kind 0, with _f) and queries (_kind 1, with _q) by their times _t."""
    asked = F.struct(*(c for c in queries.columns if c not in by))
    q = queries.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_kind"), asked.alias("_q"))
    f = facts.where(F.col(fact_time).isNotNull()).select(*by, F.col(fact_time).alias("_t"), F.lit(0).alias("_kind"), fact.alias("_f"))
    return f.unionByName(q, allowMissingColumns=True)


def prior(queries: DataFrame, facts: DataFrame, by: list[str], time: str, fact_time: str, values: list[str], width: int | None) -> DataFrame:
    """Queries with ``n_before``, the facts of their key up to their time, that time included, and ``last``: values of the latest.

    Of facts of one time the one with the greatest values counts as the latest. A query without a time has none before it, a fact without one is left out;
    a null in the key is a value like others. width: a bin's length in the unit of the times; None where a key's rows are bounded.
    """
    asked = [c for c in queries.columns if c not in by]
    rows = _sequence(queries, facts, by, time, fact_time, F.struct(*values))
    is_fact = (F.col("_kind") == 0).cast("long")
    if width is None:  # queries without a time come first
        passed = Window.partitionBy(*by).orderBy("_t", "_kind", "_f").rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("n_before", F.sum(is_fact).over(passed)).withColumn("last", F.last("_f", ignorenulls=True).over(passed)).where("_kind = 1")
        return out.select(*by, *(F.col("_q")[c].alias(c) for c in asked), "n_before", "last")
    rows = rows.withColumn("_bin", _bin(F.col("_t"), width))
    totals = rows.groupBy(*by, "_bin").agg(F.sum(is_fact).alias("_n"), F.max(F.when(F.col("_kind") == 0, F.struct("_t", "_f"))).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_bin").alias("_b"), F.sum("_n").over(earlier).alias("_before"), F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*by, "_bin").orderBy("_t", "_kind", "_f").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum(is_fact).over(inside)).withColumn("_own", F.last("_f", ignorenulls=True).over(inside)).where("_kind = 1")
    same = F.col("_bin").eqNullSafe(F.col("_b"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = rows.join(carried, same)
    known = F.col("_t").isNotNull()
    count = F.when(known, F.col("_n") + F.coalesce("_before", F.lit(0))).otherwise(F.lit(0)).cast("long")
    last = F.when(known, F.coalesce("_own", F.col("_carry")["_f"]))
    return out.select(*by, *(F.col("_q")[c].alias(c) for c in asked), count.alias("n_before"), last.alias("last"))


def within(intervals: DataFrame, points: DataFrame, by: list[str], start: str, end: str, time: str, width: int) -> DataFrame:
    """Pairs of an interval and a point of its key with start <= time <= end, all columns of both; width about an interval's length.

    An interval is sent to each bin that it touches, a point to its own, so each pair meets once. Nulls and intervals that end before they start have no pairs.
    """
    bins = F.sequence(_bin(F.col(start), width), _bin(F.col(end), width))
    sent = intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(bins))
    own = points.where(F.col(time).isNotNull()).withColumn("_bin", _bin(F.col(time), width))
    return sent.join(own, [*by, "_bin"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_bin")


def recent(queries: DataFrame, facts: DataFrame, by: list[str], time: str, fact_time: str, length: int) -> DataFrame:
    """Queries with ``n``, ``first`` and ``last``: how many facts of their key lie within ``length`` up to their time, both ends included, and the times of the first and last of them.

    What ``within`` gives for intervals of one length, counted, where a key's rows are bounded. Queries without such facts, and nulls, have no row.
    """
    asked = [c for c in queries.columns if c not in by]
    rows = _sequence(queries.where(F.col(time).isNotNull()).dropna(subset=by), facts.dropna(subset=by), by, time, fact_time, F.col(fact_time))
    near = Window.partitionBy(*by).orderBy("_t").rangeBetween(-length, 0)
    out = rows.withColumn("n", F.count("_f").over(near)).withColumn("first", F.min("_f").over(near)).withColumn("last", F.max("_f").over(near))
    return out.where("_kind = 1 AND n > 0").select(*by, *(F.col("_q")[c].alias(c) for c in asked), "n", "first", "last")
