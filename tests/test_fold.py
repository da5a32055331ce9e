"""The fold in the JVM against the replay of waveforms, sample by sample."""

import math
import random

import numpy as np
import pytest

from cadenza.streaming import detector as D
from cadenza.streaming import fold

SR = 1000


def recording(rng):
    parts = [("1" * rng.randrange(1, 40) + "0" * rng.choice([1, 4, 5, 9, 12, 25, 60, 170])) for _ in range(rng.randrange(1, 12))]
    return "0" * rng.choice([0, 3, 200]) + "".join(parts)[: rng.choice([10_000, 37, 46])]


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.997])
def test_equals_replay(spark, threshold):
    rng = random.Random(int(1000 * threshold))
    frames = [recording(rng) for _ in range(25)] + ["0" * 1700 + "1" * 12 + "0" * 1600, "1" * 9 + "0" * 100, "1" * 10]
    waves = [np.repeat([0.3 if f == "1" else 0.0 for f in x], 20).astype(np.float32).tolist() for x in frames]
    policy = D.Policy(threshold=threshold)
    whole = D.replay(spark.createDataFrame([(str(i), SR, w) for i, w in enumerate(waves)], "session string, sr int, samples array<float>"), policy).collect()
    want = sorted((r.session, round(r.t, 6), round(r.silence, 6), round(r.p_eot, 9), r.status) for r in whole)
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(frames)] + [("none", None), ("empty", "")], "session string, frames string")
    got = fold.replayed(df, threshold=threshold).collect()
    assert sorted((r.session, round(r.t, 6), round(r.silent * 0.02, 6), round(r.p_eot, 9), r.status) for r in got) == want
    assert {r.status for r in got} >= {"listening", "holding"} | ({"end_of_turn"} if threshold < 0.99 else {"end_of_turn (timeout)"})
    captions = fold.captions(fold.replayed(df, threshold=threshold)).count()
    assert captions == D.subtitles(spark.createDataFrame(whole)).count() > 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "1" * 30)], "session string, frames string").select("session", "frames")
    plan = fold.replayed(spark.range(3).selectExpr("cast(id as string) as session", "repeat('10', 40) as frames"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and df.count() == 1


def test_long_recordings_are_dealt_and_cost_what_their_length_is(spark):
    """Frames shrink to nothing in a shuffle, so that their size must not decide how many tasks there are; and no step may copy those before it."""
    from cadenza.plans import replay

    assert replay.recordings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
    long_ = spark.range(1).selectExpr("cast(id as string) as session", "repeat(repeat('1', 30) || repeat('0', 45), 2000) as frames")
    events = fold.replayed(long_)
    assert "aggregate(" not in events._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in events.orderBy("k").select("k", "silent", "has_speech", "status").collect()]
    once = [(0, True, "listening"), (0, True, "listening"), (15, True, "holding"), (30, True, "end_of_turn"), (15, False, "listening")]
    assert got == [(k, *once[k % 5]) for k in range(10_000)]


def test_chunks_need_few_passes_and_spans_join(spark):
    """Three windows over the chunks, none of which keeps the frames; and what crosses a border of spans is one run or one pause."""
    border = fold.SPAN * fold.CHUNK
    frames = {
        "run": "0" * (border - 5) + "1" * 12 + "0" * 40,
        "pause": "1" * 20 + "0" * (border - 24) + "1" * 20 + "0" * 13 + "1" * 40,
        "late": "0" * (border - 30) + "1" * 20 + "0" * 300,
        "whole": "1" * (2 * border),
    }
    events = fold.replayed(spark.createDataFrame(list(frames.items()), "session string, frames string"))
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3
    got = {}
    for r in events.orderBy("session", "k").collect():
        got.setdefault(r.session, []).append((r.k, r.silent, r.has_speech, r.status))
    for name, f in frames.items():
        silent = run = 0
        latched, want = False, []
        chunks = [f[i : i + fold.CHUNK] for i in range(0, len(f), fold.CHUNK)]
        for k, c in enumerate(chunks):
            for x in c:
                silent, run = (0, run + 1) if x == "1" else (min(silent + 1, fold.WINDOW), 0)
                latched |= run >= fold.SPEECH
            p = 1 - math.exp(-silent * fold.FRAME / 0.6)
            status = "listening" if not latched or silent < 5 else "end_of_turn (timeout)" if silent >= 150 else "end_of_turn" if silent >= 10 and p >= 0.5 else "holding"
            want.append((k, silent, latched, status))
            if status.startswith("end"):
                silent, run, latched = 0, 0, False
        if latched and silent:
            want.append((len(chunks), silent, True, "end_of_turn (end of recording)"))
        assert got[name] == want, name
