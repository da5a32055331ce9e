from pyspark.sql import functions as F

from cadenza.operators import examples as E


def test_cu_seqlens(spark):
    got = [list(r[0]) for r in spark.createDataFrame([([3, 5, 2],), ([],)], "n array<int>").select(E.cu_seqlens(F.col("n"))).collect()]
    assert got == [[0, 3, 8, 10], [0]]


def test_weights_sum_to_one(spark):
    turns = [("a", [(0.5, 0.9), (1.0, 3.0)]), ("b", [(0.0, 0.00001)]), ("c", [])]
    df = spark.createDataFrame(turns, "id string, spans array<struct<start:double,end:double>>")
    rows = E.causal(df, F.lit(16000)).collect()
    assert abs(sum(r.weight for r in rows if r.id == "a") - 1) < 1e-12
    assert {r.id for r in rows} == {"a"}
    assert [(r.span_index, r.label, r.cut_sample) for r in rows if r.id == "a"] == [(0, 0.0, 8000), (0, 0.0, 11200), (0, 0.0, 14400), (1, 1.0, 16000), (1, 1.0, 19200), (1, 1.0, 25600), (1, 1.0, 35200)]


def test_markers(spark):
    words = [("a", 0.0, 0.4), ("b", 1.0, 1.4)]
    df = spark.createDataFrame([("x", [(0.4, 1.0), (1.4, 2.0)], words, 2.0)], "id string, spans array<struct<start:double,end:double>>, words array<struct<word:string,start:double,end:double>>, duration double")
    assert [tuple(r) for r in E.markers(df).collect()] == [("x", 0, 1.0, "hold", "a"), ("x", 1, 2.0, "eot", "a b")]
    assert E.markers(df, include_holds=False).count() == 1


def test_stable_unit(spark):
    import hashlib

    got = spark.createDataFrame([("row-1",), ("é",)], "k string").select("k", E.unit(F.col("k")).alias("u")).collect()
    for r in got:
        assert r.u == int.from_bytes(hashlib.sha256(r.k.encode()).digest()[:8], "big") / 2**64


def test_offsets(spark):
    """Groups summed in parts give what one array gives; a very large group has no row of its size."""
    data = [("a" if k % 3 else None, k * k, k % 7) for k in range(200)]
    got = {}
    for r in E.offsets(spark.createDataFrame(data, "g string, k long, n int").repartition(3), "g", "k", "n", 8).orderBy("g", "i").collect():
        got.setdefault(r.g, []).append((r.i, r.start))
    for g in ("a", None):
        sums = [0]
        for x, _, n in data:
            if x == g:
                sums.append(sums[-1] + n)
        assert got[g] == list(enumerate(sums))


def test_cu_seqlens_holds_no_group_in_a_row(spark):
    from cadenza.plans import examples as P

    plan = P.cu_seqlens(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_predictions_are_paired_as_by_a_join(spark):
    """Examples without a prediction, predictions without an example, several of one key, nulls."""
    examples = [("a", 0, 0, 1.0), ("a", 0, 1, None), ("a", 1, 0, 0.0), ("b", 0, 0, 1.0), ("b", 0, 0, 0.5), (None, 0, 0, 1.0), ("c", 2, 2, 0.0)]
    told = [("a", 0, 0, 0.1), ("a", 0, 1, None), ("b", 0, 0, 0.2), ("b", 0, 0, 0.3), (None, 0, 0, 0.4), ("d", 0, 0, 0.5)]
    e = spark.createDataFrame(examples, "id string, span_index int, cut_index int, label double")
    p = spark.createDataFrame(told, "id string, span_index int, cut_index int, p_eot double")
    want = e.join(p, ["id", "span_index", "cut_index"])
    got = E.scored(e, p)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_example_predictions_shuffle_texts_only(spark):
    from cadenza import plans

    plan = plans.queries()["example_predictions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(found) == 2 and all("REPARTITION_BY_NUM" in x for x in found), found
