"""Exact linear percentiles and running sums of groups of any size.

No task holds a group: equal values are counted before they are ranked, and running sums are taken
within ranges of the key and over the ranges' totals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def decades(x: Column) -> Column:
    """Ranges for numbers of fixed steps, such as times: 64 to a decade, one for what is not positive. The steps bound what one of them holds."""
    return F.when(x > 0, F.floor(F.log10(x) * 64)).otherwise(-(1 << 40)).cast("long")


def thousandths(x: Column) -> Column:
    """Ranges for scores, which lie between 0 and 1."""
    return F.floor(x * 1024).cast("long")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def before(rows: DataFrame, by: list[str], key: str, n: str, ranges: Callable[[Column], Column] = decades) -> DataFrame:
    """rows with ``before``: the sum of n over the group's rows of a lesser key. Keys must differ within a group.

    ranges numbers a key's range; any function that never falls gives the same result.
    """
    rows = rows.withColumn("_part", ranges(F.col(key)))
    names = [f"_b{i}" for i in range(len(by))]
    totals = rows.groupBy(*(F.col(b).alias(x) for b, x in zip(by, names, strict=True)), F.col("_part").alias("_p")).agg(F.sum(n).alias("_total"))
    earlier = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.withColumn("_earlier", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*by, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = rows.join(totals, _all([F.col("_part") == F.col("_p"), *(F.col(b).eqNullSafe(F.col(x)) for b, x in zip(by, names, strict=True))]))
    return joined.withColumn("before", F.col("_earlier") + F.col("_own")).drop("_part", "_own", "_p", "_earlier", *names)


def of_counts(values: DataFrame, by: list[str], column: str, shares: tuple[float, ...]) -> DataFrame:
    """One row for each group of values that differ, with their counts ``n``: by, ``n`` (the sum), ``q`` (an array, one for each share)."""
    total = values.groupBy(*by).agg(F.sum("n").alias("_all"))
    ranked = before(values, by, column, "n")
    names = [f"_t{i}" for i in range(len(by))]
    total = total.select(*(F.col(b).alias(x) for b, x in zip(by, names, strict=True)), "_all")
    both = ranked.join(total, _all([F.col(b).eqNullSafe(F.col(x)) for b, x in zip(by, names, strict=True)])) if by else ranked.join(F.broadcast(total))
    last = F.col("before") + F.col("n")
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < last), F.col(column)))
    q = []
    for p in shares:
        h = (F.col("_all") - 1) * F.lit(float(p))
        q += [F.struct(at(F.floor(h)).alias("a"), at(F.ceil(h)).alias("b"), F.max(h - F.floor(h)).alias("t"))]
    out = both.groupBy(*by).agg(F.max("_all").alias("n"), F.array(*q).alias("_q"))
    return out.select(*by, "n", F.transform("_q", lambda x: x["a"] + (x["b"] - x["a"]) * x["t"]).alias("q"))


def percentiles(rows: DataFrame, by: list[str], column: str, shares: tuple[float, ...]) -> DataFrame:
    """One row for each group: by, ``n``, ``q``. Null values do not count; a group without values has no row."""
    values = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_x")).agg(F.count("*").alias("n"))
    return of_counts(values, by, "_x", shares)
