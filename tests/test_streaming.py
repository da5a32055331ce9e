import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cadenza.streaming import detector as D

SR = 1000


def speech(seconds):
    return (np.random.default_rng(1).standard_normal(int(seconds * SR)) * 0.2).astype(np.float32)


def recording():
    return np.concatenate([speech(0.9), np.zeros(int(1.5 * SR), np.float32), speech(0.6), np.zeros(int(0.15 * SR), np.float32)])


def test_replay_and_stream_agree(spark, tmp_path):
    x = recording()
    size = int(0.3 * SR)
    chunks = [("a", (k + 1) * 0.3, SR, x[i : i + size].tolist()) for k, i in enumerate(range(0, len(x), size))]
    df = spark.createDataFrame(chunks, "session string, t double, sr int, samples array<float>")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    out = D.detect(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("events").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    live = [tuple(r) for r in spark.table("events").orderBy("t").collect()]
    whole = D.replay(spark.createDataFrame([("a", SR, x.tolist())], "session string, sr int, samples array<float>")).orderBy("t").collect()
    assert live == [tuple(r) for r in whole if not r.status.endswith("(end of recording)")]
    assert any(r.status == "end_of_turn" for r in whole)
    assert [r.t for r in whole if r.status == "end_of_turn (end of recording)"] == [len(x) / SR]
    assert D.subtitles(spark.table("events")).count() == sum(s[4].startswith("end_of_turn") for s in live)


def test_timeout_comes_first():
    p = D.Policy()
    assert [p.decide(0.9, s) for s in (0, 0.1, 0.3, 3.0)] == ["listening", "holding", "end_of_turn", "end_of_turn (timeout)"]


def test_clicks_do_not_start_a_turn():
    s = D.Session()
    x = np.zeros(SR, np.float32)
    x[500] = 0.5
    assert s.step(1.0, SR, x, D.Policy())[2] == "listening" and not s.has_speech


def test_latest_request_wins(spark):
    df = spark.createDataFrame(pd.DataFrame({"session": ["a", "a", "b"], "request_id": [1, 2, 1], "p_eot": [0.1, 0.9, 0.5]}))
    assert {tuple(r) for r in D.latest(df).select("session", F.col("p_eot")).collect()} == {("a", 0.9), ("b", 0.5)}


def test_history_is_evicted():
    """Thirty seconds and two thousand points, and the newest always."""
    s = D.Session()
    for k in range(100):
        s.step(k * 0.5, SR, np.zeros(10, np.float32), D.Policy())
    assert s.history[:, 0].tolist() == [k * 0.5 for k in range(39, 100)]
    s.step(500.0, SR, [], D.Policy())
    assert s.history.tolist() == [[500.0, 0.0, -120.0]]
    for k in range(2100):
        s.remember(501 + k * 0.001, 0.5, np.zeros(0, np.float32))
    assert len(s.history) == D.HISTORY and s.history[-1, 0] == 501 + 2.099
    again = D.Session(*s.state())
    assert (again.history == s.history).all() and again.last_t == s.last_t


def test_reset_and_stale_chunks(spark, tmp_path):
    """A null chunk begins the session anew; chunks of one batch come in order of time, and repeated ones are dropped."""
    loud, quiet = speech(0.6).tolist(), [0.0] * 300
    rows = [("a", 0.6, loud), ("a", 0.9, quiet), ("a", 0.9, loud), ("a", 0.5, loud), ("a", 1.0, None), ("a", 1.3, quiet), ("b", 0.6, loud), ("b", 0.9, quiet)]
    df = spark.createDataFrame([(s, t, SR, x) for s, t, x in rows], "session string, t double, sr int, samples array<float>")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    out = D.detect(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("resets").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    got = {(r.session, r.t): r.status for r in spark.table("resets").collect()}
    assert got.pop(("a", 0.9)) in ("holding", "end_of_turn", "listening")
    assert set(got) == {("a", 0.5), ("a", 0.6), ("a", 1.3), ("b", 0.6), ("b", 0.9)} and got["a", 1.3] == "listening" and got["b", 0.9] == "holding"


def test_chunks_of_several_channels():
    assert D.as_mono([[0.5, -0.5], [1.0, 0.0]]).tolist() == [0.0, 0.5]
    assert D.as_mono(np.array([32767, 0], np.int16)).tolist() == [1.0, 0.0]
    assert D.as_mono([]).size == 0


def test_late_answers_are_none(spark):
    df = spark.createDataFrame([("a", 1, 0.1, 0.5), ("a", 2, 0.9, 1.5), ("b", 1, 0.5, 1.0)], "session string, request_id int, p_eot double, took double")
    assert {tuple(r) for r in D.latest(df).collect()} == {("a", 2, None), ("b", 1, 0.5)}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """By the watermark of the times of sending; what a session sends after that is a new session's."""
    import datetime

    start = datetime.datetime(2024, 1, 1)
    batches = [[("a", 1.0, 0), ("b", 1.0, 0)], [("b", 2.0, 90)], [("b", 3.0, 91)], [("a", 0.5, 92), ("b", 2.5, 92)]]
    kind = "session string, t double, sr int, samples array<float>, at timestamp"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(s, t, SR, [0.0] * 20, start + datetime.timedelta(minutes=m)) for s, t, m in rows], kind)
        df.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = D.detect(source, at="at", idle_ms=600_000)
    q = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    got = sorted((r.session, r.t) for r in spark.table("idle").collect())
    assert got == [("a", 0.5), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)]
