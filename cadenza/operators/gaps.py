"""Distribution of gaps and the threshold that it recommends.

Density and histogram work on distinct gap values with their counts: few at ticks of a millisecond, up to one
for each gap at finer ones. The density then costs its 200 grid points times the distinct gaps, summed where these are; only sums are shuffled.
Percentiles rank distinct gaps within ranges, see ``quantiles``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import quantiles as Q

PERCENTILES = (50, 75, 90, 95, 99)
BINS, BANDWIDTH, GRID, LEAST = 30, 0.12, 200, 20


def kept(gaps: DataFrame, floor: float, column: str = "gap") -> DataFrame:
    """Distinct gaps in seconds from the floor on, and how many of each."""
    return gaps.where(F.col(column) >= floor).groupBy(F.col(column).alias("gap")).agg(F.count("*").alias("n"))


def _percentiles(values: DataFrame) -> DataFrame:
    row = Q.of_counts(values, [], "gap", tuple(p / 100 for p in PERCENTILES))
    return row.select(F.coalesce("n", F.lit(0)).alias("n_gaps"), *(F.col("q")[k].alias(f"p{p}") for k, p in enumerate(PERCENTILES)))


def percentiles(gaps: DataFrame, floor: float, column: str = "gap") -> DataFrame:
    """One row: n_gaps and linear percentiles, null where there is no gap."""
    return _percentiles(kept(gaps, floor, column))


def _range(values: DataFrame) -> DataFrame:
    return values.agg(F.log10(F.min("gap")).alias("lo"), F.log10(F.max("gap")).alias("hi"), F.sum("n").alias("total"))


def log_histogram(gaps: DataFrame, floor: float, column: str = "gap", bins: int = BINS) -> DataFrame:
    """(bin, n): bins of equal width in log10 from the least gap to the largest, the last one closed; empty bins included."""
    values = kept(gaps.where(F.col(column) > 0), floor, column)
    bounds = _range(values).withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1))
    at = F.least(F.floor((F.log10("gap") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("long")
    counted = values.join(F.broadcast(bounds)).groupBy(at.alias("bin")).agg(F.sum("n").alias("n"))
    every = gaps.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bar(n: Column, most: Column, width: int = 50) -> Column:
    return F.repeat(F.lit("#"), F.rint(n / most * width).cast("int"))


def density(gaps: DataFrame, floor: float, column: str = "gap", grid: int = GRID, bandwidth: float = BANDWIDTH, least: int = LEAST) -> DataFrame:
    """(i, x, density) on an even grid in log10 seconds; no rows below ``least`` gaps or where all are equal."""
    return _density(kept(gaps, floor, column), grid, bandwidth, least)


def _density(values: DataFrame, grid: int = GRID, bandwidth: float = BANDWIDTH, least: int = LEAST) -> DataFrame:
    spark = values.sparkSession
    values = values.where("gap > 0")
    bounds = _range(values).where((F.col("total") >= least) & (F.col("hi") > F.col("lo")))
    points = spark.range(grid).withColumnRenamed("id", "i").join(F.broadcast(bounds)).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (grid - 1))
    z = (F.log10("gap") - F.col("x")) / bandwidth
    mass = F.sum(F.col("n") * F.exp(-0.5 * z * z)) / (F.first("total") * bandwidth * math.sqrt(2 * math.pi))
    return values.join(F.broadcast(points)).groupBy("i", "x").agg(F.round(mass, 9).alias("density"))


def extrema(curve: DataFrame) -> DataFrame:
    """Grid points with ``kind`` peak or trough: strict on the left, so that a plateau counts at its first point; never an end."""
    w = Window.orderBy("i")  # the grid has a fixed number of points
    a, b = F.lag("density").over(w), F.lead("density").over(w)
    d = F.col("density")
    kind = F.when((d > a) & (d >= b), "peak").when((d < a) & (d <= b), "trough")
    return curve.withColumn("kind", kind).where("kind IS NOT NULL")


def valley(gaps: DataFrame, floor: float, column: str = "gap") -> DataFrame:
    """One row: n_gaps, the two modes and the valley between them if there are such, and the recommended gap.

    The recommendation is the valley (3 decimals), else the 75th percentile, else five times the floor.
    """
    values = kept(gaps, floor, column)  # one shuffle, which all that follows shares
    points = extrema(_density(values))
    w = Window.orderBy(F.col("density").desc(), "i")
    tops = points.where("kind = 'peak'").withColumn("k", F.row_number().over(w)).where("k <= 2")
    modes = tops.agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"))
    between = points.where("kind = 'trough'").join(F.broadcast(modes), (F.col("n") == 2) & (F.col("i") > F.col("a")) & (F.col("i") < F.col("b")))
    deepest = between.agg(F.min_by("x", F.struct("density", "i")).alias("v"))
    row = _percentiles(values).join(F.broadcast(modes.select("x1", "x2", F.col("n").alias("n_modes")))).join(F.broadcast(deepest))
    ten = lambda c: F.round(F.pow(F.lit(10.0), c), 6)
    v = F.pow(F.lit(10.0), F.col("v"))
    return row.select(
        "n_gaps",
        F.when(F.col("n_modes") > 0, ten("x1")).alias("mode_low"),
        F.when(F.col("n_modes") > 1, ten("x2")).alias("mode_high"),
        F.round(v, 6).alias("valley"),
        F.coalesce(F.round(v, 3), F.round("p75", 6), F.lit(5 * floor)).alias("recommended"),
    )
