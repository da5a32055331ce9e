import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import audio
from cadenza.operators import degrade
from cadenza.sources import alignments, sinks
from cadenza.sources import zip_audio as Z


def test_zip_archives_first_wins(spark, tmp_path):
    for name, members in (("ms-0.zip", {"a.wav": b"1", "b.wav": b"2"}), ("ms-1.zip", {"a.wav": b"3", "c.wav": b"4"}), ("xx.zip", {"d.wav": b"5"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m, data in members.items():
                z.writestr(m, data)
    spark.dataSource.register(Z.ZipAudio)
    df = spark.read.format("zipaudio").option("prefix", "ms-").load(str(tmp_path))
    assert df.count() == 4
    assert {(r.member, bytes(r.content)) for r in Z.first_wins(df).collect()} == {("a.wav", b"1"), ("b.wav", b"2"), ("c.wav", b"4")}
    assert Z.discover(str(tmp_path), "ms-", 1) == ["ms-0.zip"]


def test_external_alignments(spark):
    t = "<|0.50|> hi<|0.80|>"
    rows = spark.createDataFrame([(1, "whole", "word", [t, t, ""], ["a", "b"]), (2, "whole", "segment", [t], ["a"]), (3, "streaming", "word", [t], ["a"])], "n int, mode string, level string, texts array<string>, audio_filenames array<string>")
    members = spark.createDataFrame([("a", b"x")], "member string, content binary")
    got = alignments.external(rows, members, "whole", "n").collect()
    assert [(r.source_id, r.words[0].start) for r in got] == [("1_0", 0.5)]
    got = alignments.external(rows, members, "streaming", "n").collect()
    assert [(r.source_id, r.words[0].start) for r in got] == [("3_0", 0.0)]


def test_embedded_limit_counts_scanned_rows(spark):
    kind = "n int, words array<struct<word:string,text:string,token:string,start:string,end:string>>"
    rows = spark.createDataFrame([(0, []), (1, [("a", None, None, "0", "1")]), (2, [("b", None, None, "0", "1")])], kind)
    assert [r.source_id for r in alignments.embedded(rows, "en", "n", limit=2).collect()] == ["en_1"]


def test_wav_round_trip(spark):
    x = np.sin(np.arange(800) / 10).astype(np.float32) * 0.5
    df = spark.createDataFrame([(x.tolist(), 8000), ([], 8000)], "x array<float>, sr int")
    got = df.select(audio.wav_samples(audio.wav_bytes("x", "sr")).alias("s")).collect()
    assert np.abs(np.array(got[0].s.samples) - x).max() < 1e-4 and got[0].s.rate == 8000
    assert spark.createDataFrame([(b"junk",)], "d binary").select(audio.wav_samples("d").alias("s")).first().s.samples is None
    with pytest.raises(ValueError):
        audio.encoder("mp3")


def test_sinks(spark, tmp_path):
    row = spark.range(3).select(F.col("id").cast("string").alias("id"), F.struct(F.lit(b"x").alias("bytes"), F.lit("p").alias("path")).alias("audio"), F.lit("en").alias("language"), F.lit(1.0).alias("duration"), F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))).alias("silence_spans"), F.array(F.struct(F.lit("w").alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))).alias("words"), F.array(F.struct(F.lit("user").alias("role"), F.lit("w").alias("content"))).alias("messages"))
    sinks.write_turns(row, str(tmp_path / "t"), per_file=2)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.columns == sinks.COLUMNS and back.count() == 3
    assert (tmp_path / "t" / "_features.json").exists()
    with pytest.raises(ValueError):
        sinks.write_turns(row.limit(0), str(tmp_path / "u"))
    assert "| en | 3 |" in sinks.card(back, "x")


def test_channel_repeats(spark):
    x = (np.random.default_rng(0).standard_normal(4000) * 0.1).tolist()
    df = spark.createDataFrame([(k, x, 16000) for k in range(6)] + [(9, [], 16000)], "id long, samples array<float>, rate int")
    a = degrade.degraded(df, degrade.Channel(packet_loss=0.5)).orderBy("id").collect()
    b = degrade.degraded(df.repartition(3), degrade.Channel(packet_loss=0.5)).orderBy("id").collect()
    assert a == b
    assert all(len(r.samples) == 4000 for r in a if r.id != 9) and any(r.trace.applied for r in a)


def test_embedded_audio_is_decoded(spark):
    """Rows whose bytes are no audio, or missing, are left out like those without words."""
    kind = "n int, words array<struct<word:string,text:string,token:string,start:string,end:string>>, audio binary"
    one = [("a", None, None, "0", "1")]
    rows = spark.createDataFrame([(0, one, audio.encode_wav(np.array([0.5, -0.5]), 8000)), (1, one, b"junk"), (2, [], audio.encode_wav(np.zeros(3), 8000)), (3, one, None)], kind)
    got = alignments.embedded(rows, "en", "n", mode="segment").collect()
    assert [(r.source_id, r.sr, len(r.audio), r.mode) for r in got] == [("en_0", 8000, 2, "segment")]


def test_scan_fails_where_nothing_matches(spark, tmp_path):
    from cadenza.sources import adapters

    spark.range(3).write.parquet(str(tmp_path / "x"))
    assert adapters.scan(spark, str(tmp_path / "x"), "part-*.parquet").count() == 3
    with pytest.raises(FileNotFoundError):
        adapters.scan(spark, str(tmp_path / "x"), "none-*.parquet")


def test_reports_and_bias_records(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("a", "en", 1.0, 0.75, 2.5), ("b", "de", 0.0, 0.25, 1.0)], "id string, language string, label double, p_eot double, duration double")
    sinks.write_bias_csv(rows, str(tmp_path / "csv"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {("a", "1.0", "2.5", "0.75"), ("b", "0.0", "1.0", "0.25")}
    metrics = spark.createDataFrame([("overall", 2, 0.5)], "grp string, n long, f1 double")
    sinks.write_report(rows, metrics, {"turns": 2}, str(tmp_path / "report"))
    told = json.loads((tmp_path / "report" / "report.json").read_text())
    assert told["args"]["turns"] == 2 and told["metrics"] == [{"f1": 0.5, "grp": "overall", "n": 2}]
    assert spark.read.json(told["args"]["predictions"]).count() == 2


def test_predictor_loads_once_and_scores_batches(spark):
    from cadenza.functions import scores

    def make():
        return lambda audio, rate: [float(sum(x)) / r for x, r in zip(audio, rate, strict=True)]

    df = spark.createDataFrame([([1.0, 2.0], 2), ([4.0], 8)], "x array<double>, sr int")
    assert [r.p for r in df.select(scores.predictor(make)("x", "sr").alias("p")).collect()] == [1.5, 0.5]


def test_mono_and_pcm(spark):
    from cadenza.functions import waves

    df = spark.createDataFrame([([[1.0, 3.0], [-2.0, 0.0]],)], "x array<array<double>>")
    assert df.select(waves.mono(F.col("x")).alias("m")).first().m == [2.0, -1.0]
    assert np.frombuffer(audio.to_pcm16([0.0, 1.5, -1.5, 0.5]), "<i2").tolist() == [0, 32767, -32767, 16383]
