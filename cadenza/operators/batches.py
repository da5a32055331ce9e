"""Micro-batches of examples in a seeded order, by count or by a token budget.

The order is that of a hash. Its ranges (by the hash's first digits) follow the number of rows, so a task packs a few hundred rows at a time; counts over
the ranges, of which there are far fewer, give every batch its number. No task holds the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.sampling import draw, ranks

RANGE = 512  # about so many rows in a range


def by_count(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """rows with ``batch`` and ``place`` in it: each batch but the last has size rows."""
    ranked = ranks(rows.withColumn("_all", F.lit(0)), key, ["_all"], seed).drop("_all", "group_size")
    return ranked.withColumn("batch", F.floor(F.col("rank") / size).cast("long")).withColumn("place", (F.col("rank") % size).cast("int")).drop("rank")


def digits(rows: int, each: int = RANGE) -> int:
    """Hexadecimal digits of the hash whose ranges hold at most about each rows."""
    n = 0
    while rows > each * 16**n:
        n += 1
    return n


def cuts(sizes: Column, budget: int) -> Column:
    """For sizes in order, the batch of each: a new one begins where the next would pass the budget. One beyond the budget is a batch of its own."""

    def step(a: Column, n: Column) -> Column:
        full = (a["used"] > 0) & (a["used"] + n > budget)
        batch = F.when(full, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(batch.alias("batch"), F.when(full, n).otherwise(a["used"] + n).alias("used"), F.array_append(a["out"], batch).alias("out"))

    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, step, lambda a: a["out"])


def by_budget(rows: DataFrame, key: str, tokens: str, budget: int, seed: int = 42, prefix: int | None = None) -> DataFrame:
    """(key, tokens, batch, place, start): batches of examples whose tokens fit a budget, in the seeded order; start is the first token's place in the batch.

    A batch also ends where a range of the order does. Examples with null or no tokens are left out. prefix: digits of the hash that make a range; from the number of rows, if not given.
    """
    some = rows.where(F.col(tokens) > 0).select(key, F.col(tokens).cast("long").alias(tokens))
    prefix = digits(some.count()) if prefix is None else prefix
    hashed = some.withColumn("_h", draw(F.col(key), seed)).withColumn("_r", F.substring("_h", 1, prefix))
    packed = hashed.groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("_h", key, tokens))).alias("e"))
    packed = packed.withColumn("b", cuts(F.transform("e", lambda x: x[tokens]), budget))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = packed.select("_r", (F.element_at("b", -1) + 1).alias("n")).withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    flat = packed.select("_r", F.explode(F.arrays_zip("e", "b")).alias("x")).join(first, "_r")
    flat = flat.select("_r", F.col(f"x.e.{key}").alias(key), F.col(f"x.e.{tokens}").alias(tokens), F.col("x.e._h").alias("_h"), (F.col("_first") + F.col("x.b")).cast("long").alias("batch"))
    own = Window.partitionBy("_r", "batch").orderBy("_h", key)
    return flat.select(key, tokens, "batch", (F.row_number().over(own) - 1).alias("place"), F.coalesce(F.sum(tokens).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
