"""Keyed state over micro-batches: equal to a replay, restarted from a checkpoint, bounded; and requests of which the newest wins."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.streaming import detector as D
from cadenza.streaming import live as L

pytest.importorskip("google.protobuf")
SR = 1000
CHUNKS = "session string, t double, sr int, samples array<float>"


def speech(seconds, seed=1):
    return (np.random.default_rng(seed).standard_normal(int(seconds * SR)) * 0.2).astype(np.float32)


def recording(seed, turns):
    quiet = lambda s: np.zeros(int(s * SR), np.float32)
    return np.concatenate([x for k in range(turns) for x in (speech(0.6 + 0.3 * (k % 3), seed + k), quiet(0.2 + 0.5 * (k % 4)))])


def chunks(session, x):
    size = int(0.3 * SR)
    return [(session, (k + 1) * 0.3, SR, x[i : i + size].tolist()) for k, i in enumerate(range(0, len(x), size))]


def run(spark, path, out, name):
    q = out.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/{name}").collect())


def test_equals_replay_over_restarts(spark, tmp_path):
    """Batches of a few chunks, with the query stopped and started between them from its checkpoint."""
    files = {s: recording(k, 14) for k, s in enumerate("ab")}
    told = sorted((r for s, x in files.items() for r in chunks(s, x)), key=lambda r: r[1])
    path = str(tmp_path)
    for part in range(3):
        some = told[part * len(told) // 3 : (part + 1) * len(told) // 3]
        spark.createDataFrame([*some, some[0]], CHUNKS).coalesce(1).write.mode("append").parquet(f"{path}/in")  # one comes twice
        got = run(spark, path, L.live(spark.readStream.schema(CHUNKS).parquet(f"{path}/in")), "out")
    whole = D.replay(spark.createDataFrame([(s, SR, x.tolist()) for s, x in files.items()], "session string, sr int, samples array<float>")).collect()
    assert got == sorted(tuple(r) for r in whole if not r.status.endswith("(end of recording)"))
    assert sum(r[4].startswith("end_of_turn") for r in got) > 4


def test_state_is_bounded(tmp_path):
    """Ten minutes of talk without a pause: no more than one and a half windows are held, and a batch appends."""

    class Value:
        def __init__(self):
            self.x, self.writes = None, 0

        def get(self):
            return self.x

        def update(self, x):
            self.x = x

        def clear(self):
            self.x = None

    class List:
        def __init__(self):
            self.x, self.written = [], 0

        def get(self):
            return iter(self.x)

        def put(self, x):
            self.x = list(x)
            self.written += sum(len(v[0]) if isinstance(v[0], bytes) else 24 for v in x)

        def appendList(self, x):
            self.x += x
            self.written += sum(len(v[0]) if isinstance(v[0], bytes) else 24 for v in x)

        def clear(self):
            self.x = []

    class Handle:
        def __init__(self):
            self.timers, self.states = [], {}

        def getValueState(self, name, *_):
            return self.states.setdefault(name, Value())

        def getListState(self, name, *_):
            return self.states.setdefault(name, List())

        def listTimers(self):
            return self.timers

        def deleteTimer(self, at):
            self.timers.remove(at)

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 7

    import pandas as pd

    handle, d = Handle(), L.Detector(D.Policy(), D.heuristic, "at", 1000)
    d.init(handle)
    x = speech(600)
    told, plain = chunks("s", x), D.Session()
    most = 0
    for k in range(0, len(told), 5):
        batch = pd.DataFrame(told[k : k + 5], columns=["session", "t", "sr", "samples"]).assign(at=pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=k))
        got = pd.concat(d.handleInputRows(("s",), iter([batch]), Now()))
        want = [plain.step(t, sr, samples, D.Policy()) for _, t, sr, samples in told[k : k + 5]]
        assert [tuple(r) for r in got[["silence", "p_eot", "status"]].itertuples(index=False)] == want
        most = max(most, sum(len(v[0]) for v in handle.states["audio"].x))
    assert most <= 1.5 * 30 * SR * 4 + 6000 and len(handle.timers) == 1
    assert handle.states["audio"].written < 4.5 * x.nbytes  # a blob would be written anew with each batch: 20 times as much
    assert len(handle.states["history"].x) <= 151
    list(d.handleExpiredTimer(("s",), Now(), None))
    assert handle.states["flags"].x is None and not handle.states["audio"].x


def test_reset(spark, tmp_path):
    x = recording(3, 4)
    told = chunks("a", x)
    cut = len(told) // 2
    rows = [*told[:cut], ("a", told[cut][1] - 0.15, SR, None), *told[cut:]]
    spark.createDataFrame(rows, CHUNKS).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = run(spark, str(tmp_path), L.live(spark.readStream.schema(CHUNKS).parquet(f"{tmp_path}/in")), "out")
    want = []
    for part in (told[:cut], told[cut:]):
        s = D.Session()
        want += [("a", t, *s.step(t, sr, samples, D.Policy())) for _, t, sr, samples in part]
    assert got == sorted(want)


REQUESTS = "session string, kind string, request_id long, at timestamp, silence double, p_eot double"


def at(ms):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(milliseconds=ms)


def test_newest_request_wins_across_batches(spark, tmp_path):
    path = str(tmp_path)
    batches = [
        [("a", "request", 1, at(0), 0.3, None), ("b", "request", 1, at(0), 0.1, None), ("c", "request", 5, at(0), 0.4, None)],
        [("a", "request", 2, at(300), 0.4, None), ("a", "answer", 1, at(350), None, 0.1), ("b", "answer", 1, at(350), None, 0.2)],  # superseded; gated
        [("a", "request", 1, at(380), 0.4, None), ("a", "answer", 2, at(400), None, 0.9), ("a", "answer", 1, at(410), None, 0.3)],  # an older one comes late
        [("z", "request", 1, at(9000), 0.5, None)],  # time goes on: c's deadline
        [("c", "answer", 5, at(9100), None, 0.7), ("c", "request", 6, at(9200), 0.5, None), ("c", "answer", 6, at(9300), None, 0.8), ("z", "answer", 1, at(9500), None, 0.6)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        got = run(spark, path, L.answered(spark.readStream.schema(REQUESTS).parquet(f"{path}/in")), "out")
    assert sorted(got) == [("a", 2, 0.9, "answered"), ("c", 5, None, "fallback"), ("z", 1, 0.6, "answered")]
