from pyspark.sql import functions as F

from cadenza.functions import text as T


def words(spark, text):
    return [tuple(r) for r in spark.createDataFrame([(text,)], "t string").select(T.parse_timestamped(F.col("t")).alias("w")).first().w]


def test_timestamped_words(spark):
    got = words(spark, "<|1.5|>never<|1.75|><|1.75|> two <|2|><|8.25|>alike<|9|>")
    assert got == [("never", 1.5, 1.75), ("two", 1.75, 2.0), ("alike", 8.25, 9.0)]


def test_timestamped_degenerate(spark):
    assert words(spark, " ") == []
    assert words(spark, "plain < text | with > signs") == []
    assert words(spark, "<|7.0|>") == []
    assert words(spark, "<|7.0|> and nothing after") == []
    assert words(spark, "<|0|> a line\nand another<|60.5|>") == [("a line\nand another", 0.0, 60.5)]
    assert words(spark, "<|9.5|>late<|3.5|>") == [("late", 9.5, 9.5)]


def test_normalized(spark):
    kind = "array<struct<word:string,text:string,token:string,start:string,end:string>>"
    rows = [(None, "hi", None, "0.5", "0.2"), ("  ", None, None, "1", "2"), ("x", None, None, None, "2"), ("y", None, None, "abc", "2"), (None, None, " ok ", "0.1", "0.3"), None, ("n", None, None, "NaN", "1")]
    got = spark.createDataFrame([(rows,)], f"w {kind}").select(T.normalized(F.col("w")).alias("w")).first().w
    assert [tuple(x) for x in got] == [("ok", 0.1, 0.3), ("hi", 0.5, 0.5)]


def test_sentence_end(spark):
    cases = {"finished.": True, "Mr.": False, "vs.": False, "Q.": False, "Q.E.": True, "going": False, "really?!!": True, "?!": False, "終わり。": True, "": False, "(end.)": False, "stop…": True, "St": False}
    got = {r.w: r.s for r in spark.createDataFrame([(k,) for k in cases], "w string").select("w", T.sentence_end(F.col("w")).alias("s")).collect()}
    assert got == cases


def test_audio_tokens(spark):
    got = [r[0] for r in spark.createDataFrame([(3000,), (1,), (0,), (-5,)], "n int").select(T.audio_tokens(F.col("n"))).collect()]
    assert got == [1500, 1, 0, 0]


def test_knobs_out_of_range():
    import pytest

    from cadenza.config import TurnConfig

    for bad, names in (({"lead_in": -0.1, "min_words": 1.5}, ("lead_in", "min_words")), ({"mode": "words"}, ("mode",)), ({"ticks": 0}, ("ticks",)), ({"turn_gap": float("nan")}, ("turn_gap",)), ({"eot_trailing": 2.0}, ("eot_trailing",)), ({"mode": "segment", "turn_gap": 0.1}, ("turn_gap",)), ({"min_silence": "0.1"}, ("min_silence",))):
        with pytest.raises(ValueError) as told:
            TurnConfig(**bad)
        assert all(f"{n} is" in str(told.value) for n in names)
    assert TurnConfig(mode="single", turn_gap=0.05).tick("turn_gap") == 50
