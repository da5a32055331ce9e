"""Reproducible samples, splits and file picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A hash to order rows by, the same on any cluster."""
    return F.sha2(F.concat(key.cast("string"), F.lit(f":{seed}")), 256)


def sampled(rows: DataFrame, key: str, limit: int, seed: int = 42) -> DataFrame:
    """The limit rows of least hash; all rows where limit is not positive."""
    return rows if limit <= 0 else rows.orderBy(draw(F.col(key), seed), key).limit(limit)


def ranks(rows: DataFrame, key: str, by: list[str], seed: int = 42) -> DataFrame:
    """rows with ``rank``, the place from 0 in its group's hash order, and ``group_size``.

    Ranks come in two steps, within 4096 ranges of the hash and over the counts of these, so
    that a group of any size is ranked in parts.
    """
    rows = rows.withColumn("_h", draw(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("group_size", F.sum("_c").over(w))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", key)
    ranked = rows.withColumn("_k", F.row_number().over(inside) - 1).join(counts, [*by, "_b"])
    return ranked.withColumn("rank", F.col("_k") + F.col("_before")).drop("_h", "_b", "_c", "_before", "_k")


def split(rows: DataFrame, key: str, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Rows with ``split``: the first half of each group in hash order trains, a quarter validates, the rest tests."""
    ranked = ranks(rows, key, by or [], seed)
    half, quarter = F.floor(F.col("group_size") / 2), F.floor(F.col("group_size") / 4)
    name = F.when(F.col("rank") < half, "train").when(F.col("rank") < half + quarter, "validation").otherwise("test")
    return ranked.withColumn("split", name).drop("rank", "group_size")


def last_file(files: DataFrame, name: str = "name", prefix: str = "") -> DataFrame:
    """The last file of each key, the key being the first two parts of its name, of the files whose names start with a prefix."""
    return files.where(F.col(name).startswith(prefix)).groupBy(F.substring_index(name, "-", 2).alias("key")).agg(F.max(name).alias("last"))


def shard_sizes(limit: Column, concurrency: Column, files: Column) -> Column:
    """How many shards and how many rows each."""
    shards = F.greatest(F.least(concurrency, files), F.lit(1))
    return F.struct(shards.alias("shards"), F.ceil(limit / shards).alias("per_shard"))
