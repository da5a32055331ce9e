"""Joins in time against all pairs: ties, nulls, far bins, a key that holds most rows."""

import random

import pytest

from cadenza import plans
from cadenza.operators import asof

DATA = "/root/testdata/sf0.001"


def tables(seed):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
    queries = [(key(), rng.choice([None, *range(-50, 300, 7)]), i) for i in range(120)]
    facts = [(key(), rng.choice([None, *range(-60, 280, 5)]), rng.choice("xyz")) for _ in range(150)]
    return queries, facts


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_prior(spark, width):
    queries, facts = tables(width)
    q, f = spark.createDataFrame(queries, "k string, t long, i int"), spark.createDataFrame(facts, "k string, at long, v string")
    got = {r.i: (r.k, r.t, r.n_before, r.last and r.last.v) for r in asof.prior(q, f, ["k"], "t", "at", ["v"], width).collect()}
    for k, t, i in queries:
        before = sorted((at, v) for other, at, v in facts if other == k and at is not None and t is not None and at <= t)
        assert got[i] == (k, t, len(before), before[-1][1] if before else None)
    assert len(got) == len(queries)


@pytest.mark.parametrize("width", [3, 40])
def test_within(spark, width):
    queries, facts = tables(width + 1)
    spans = [(k, t, None if t is None else t + random.Random(i).randrange(-5, 60), i) for k, t, i in queries]
    q, f = spark.createDataFrame(spans, "k string, s long, e long, i int"), spark.createDataFrame([(*x, j) for j, x in enumerate(facts)], "k string, at long, v string, j int")
    got = sorted((r.i, r.j) for r in asof.within(q, f, ["k"], "s", "e", "at", width).collect())
    assert got == sorted((i, j) for k, s, e, i in spans for j, (other, at, _) in enumerate(facts) if k is not None and k == other and s is not None and at is not None and s <= at <= e)


def test_empty(spark):
    q, f = spark.createDataFrame([("a", 1)], "k string, t long"), spark.createDataFrame([], "k string, at long, v string")
    assert [tuple(r) for r in asof.prior(q, f, ["k"], "t", "at", ["v"], 5).collect()] == [("a", 1, 0, None)]
    assert asof.prior(q.limit(0), f, ["k"], "t", "at", ["v"], 5).count() == 0


def test_a_hot_key_is_split(spark):
    """One key with all rows: no task of the final join gets more than a few bins, and nothing is compared pair by pair."""
    from pyspark.sql import functions as F

    facts = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.lit("v").alias("v"))
    queries = spark.range(0, 20_000, 5).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof.prior(queries, facts, ["k"], "t", "at", ["v"], 500)
        sizes = [r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2500
        assert out.where("n_before <> t + 1").count() == 0
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_same_rows_as_nested(spark):
    flat = plans.queries()["asof_range_join"](spark, DATA).select("id", "span_index", "n_words")
    nested = plans.queries()["asof_prior_words"](spark, DATA).select("id", "span_index", "n_words")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, nested.collect()))


def test_turns_are_named_once_at_the_end(spark):
    for name in ("asof_range_join", "interval_join"):
        plan = plans.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("concat_ws(") == 1, name


@pytest.mark.parametrize("seed", [1, 2])
def test_prior_in_one_sequence(spark, seed):
    """Without a width: bounded keys, no bins, the same rows."""
    queries, facts = tables(seed)
    q, f = spark.createDataFrame(queries, "k string, t long, i int"), spark.createDataFrame(facts, "k string, at long, v string")
    rows = lambda width: sorted(map(repr, asof.prior(q, f, ["k"], "t", "at", ["v"], width).collect()))
    assert rows(None) == rows(10)


@pytest.mark.parametrize("length", [0, 40])
def test_recent_counts_what_within_pairs(spark, length):
    """Intervals of one length, with ties, nulls and keys without a row: counted as they pass, or from the pairs."""
    from pyspark.sql import functions as F

    queries, facts = tables(length + 5)
    q, f = spark.createDataFrame(queries, "k string, t long, i int"), spark.createDataFrame(facts, "k string, at long, v string")
    pairs = asof.within(q.withColumn("s", F.col("t") - length), f, ["k"], "s", "t", "at", length + 1)
    want = pairs.groupBy("k", "i").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    got = asof.recent(q, f, ["k"], "t", "at", length)
    assert sorted(map(tuple, got.select("k", "i", "n", "first", "last").collect())) == sorted(map(tuple, want.collect()))


def exchanged(df):
    """What the shuffles of a plan hold."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line]


@pytest.mark.parametrize("name", ["asof_range_join", "interval_join"])
def test_joins_shuffle_texts_only(spark, name):
    found = exchanged(plans.queries()[name](spark, DATA))
    assert len(found) == 2 and all("REPARTITION_BY_NUM" in x for x in found), found


def test_a_task_gets_few_texts(spark):
    """Partitions follow the size of the file, small ones until they are many."""
    from cadenza.sources import adapters as A

    class Known:  # a table of so many bytes
        sparkSession = spark

        def __init__(self, size):
            stats = type("S", (), {"sizeInBytes": lambda _: size})()
            plan = type("P", (), {"stats": lambda _: stats})()
            self._jdf = type("J", (), {"queryExecution": lambda _: type("Q", (), {"optimizedPlan": lambda _: plan})()})()

    size = lambda n, *a: A.partitions(Known(n), *a)
    assert [size(n, 4 << 20, 64 << 20) for n in (0, 6 << 30, 100 << 30, 1 << 40)] == [4, 1536, 4096, 16384]
    assert size(6 << 30, 1 << 20) == 6144
