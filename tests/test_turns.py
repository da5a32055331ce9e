import random

import pytest
from pyspark.sql import functions as F

from cadenza.config import TurnConfig
from cadenza.operators import rows as R
from cadenza.operators import turns as O
from cadenza.plans import turns

WORDS = "rec long, pos long, word string, start long, end long"


def frame(spark, words, rec=1):
    return spark.createDataFrame([(rec, k, *w) for k, w in enumerate(words)], WORDS)


def model(words, cfg, sentence_end=lambda w: w.endswith(".")):
    """Plain restatement of the rules for one recording."""
    t = cfg.tick
    ws = sorted((w for w in words if w[2] >= w[1]), key=lambda w: (w[1], w[2]))
    groups, own = [], []
    for i, w in enumerate(ws):
        own.append(i)
        gap = ws[i + 1][1] - w[2] if i + 1 < len(ws) else None
        wide = gap is not None and gap >= t("turn_gap")
        if gap is None or (cfg.mode == "segment" and wide) or (cfg.mode == "sentence" and (wide or sentence_end(w[0]))):
            groups.append(own)
            own = []
    out = []
    for g in groups:
        holds = [(ws[i][2], ws[i + 1][1]) for i in g[:-1] if ws[i + 1][1] - ws[i][2] >= t("min_silence")]
        lo, hi = ws[g[0]], ws[g[-1]]
        nxt = ws[g[-1] + 1] if g[-1] + 1 < len(ws) else None
        prev = ws[g[0] - 1] if g[0] else None
        trail = max(0, min(nxt[1] - hi[2], t("max_trailing")) - t("eot_guard")) if nxt else min(t("eot_trailing"), t("max_trailing"))
        start = lo[1] - max(0, min(t("lead_in"), lo[1] - prev[2]) - t("eot_guard")) if prev else max(0, lo[1] - t("lead_in"))
        if len(g) >= cfg.min_words and len(holds) >= cfg.min_hold_spans:
            out.append(([ws[i][0] for i in g], [*holds, (hi[2], hi[2] + trail)], start, hi[2] + trail))
    return out


@pytest.mark.parametrize("mode", ["single", "segment", "sentence"])
@pytest.mark.parametrize("least", [(1, 0), (2, 1)])
def test_turns_equal_model(spark, mode, least):
    rng = random.Random(7)
    cfg = TurnConfig(mode=mode, min_words=least[0], min_hold_spans=least[1])
    recs = []
    for rec in range(25):
        at, ws = rng.randrange(3) * 100, []
        for k in range(rng.randrange(1, 12)):
            at += rng.choice([-50, 0, 60, 100, 300, 700, 1500])
            ws.append((f"w{k}" + rng.choice(["", "", "."]), max(0, at), max(0, at) + rng.choice([-10, 0, 100, 250])))
            at = ws[-1][2]
        recs.append(ws)
    df = spark.createDataFrame([(r, k, *w) for r, ws in enumerate(recs) for k, w in enumerate(ws)], WORDS)
    got = {}
    for r in O.turns(df, cfg).orderBy("rec", "turn_index").collect():
        got.setdefault(r.rec, []).append(([w.word for w in r.words], [tuple(s) for s in r.spans], r.window_start, r.window_end))
    assert got == {r: m for r, ws in enumerate(recs) if (m := model(ws, cfg))}


def test_gap_equal_to_threshold_splits(spark):
    df = frame(spark, [("a", 0, 100), ("b", 800, 900)])
    assert O.turns(df, TurnConfig(mode="segment")).count() == 2


def test_trailing_guard(spark):
    cfg = TurnConfig(mode="segment", turn_gap=0.3, min_silence=0.1)
    first = O.turns(frame(spark, [("a", 0, 100), ("b", 400, 500)]), cfg).orderBy("turn_index").first()
    assert first.window_end - first.last_end == 250


def test_empty(spark):
    assert O.turns(spark.createDataFrame([], WORDS), TurnConfig()).count() == 0


def test_last_hold_becomes_end_of_turn(spark):
    spans = [(100, 200), (900, 900)]
    df = spark.createDataFrame([(spans, 0, 950)], "s array<struct<start:long,end:long>>, w long, d long")
    got = df.select(R.clipped_spans(F.col("s"), F.col("w"), F.col("d"), 80).alias("s")).first().s
    assert [tuple(x) for x in got] == [(100, 950)]


def test_config_checks():
    for bad in ({"mode": "x"}, {"eot_trailing": 2.0}, {"mode": "segment", "turn_gap": 0.1}):
        with pytest.raises(ValueError):
            TurnConfig(**bad)


def test_whisper_parse_of_literal_stamps(spark, tmp_path):
    """Texts with markup, code and literal stamps come back whole."""
    texts = ["a <b>bold</b> if x < y", "<|0.5|> <|1|>x<|2|> <\\|3|> <\\\\| \\ <| |> $1", "plain words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in turns.QUERIES["whisper_parse"](spark, str(tmp_path)).orderBy("rec", "i").collect():
        got.setdefault(r.rec, []).append(r.word)
    assert got == {k: t.split() for k, t in enumerate(texts)}


def test_clip_against_plain_python(spark):
    """Rows with audio, recording by recording: window, padding, trim, gate and spans restated on lists."""
    import numpy as np

    from cadenza.operators import rows as R

    sr, rng = 1000, np.random.default_rng(4)
    cases = []
    for k in range(12):
        ends = rng.integers(300, 900)
        x = rng.standard_normal(int(rng.integers(500, 1500))) * 0.3
        x[ends:] *= (0.0, 1e-4, 1.0)[k % 3]
        word_end, window_end = int(ends - 20 * (k % 2)), int(ends + rng.integers(100, 600))
        cases.append((k, x.tolist(), [("a", 60, 200), ("b", 260, word_end)], [(200, 260), (word_end, window_end)], int(rng.integers(0, 60)), window_end))
    kind = "rec int, audio array<double>, words array<struct<word:string,start:long,end:long>>, spans array<struct<start:long,end:long>>, window_start long, window_end long"
    got = {r.rec: r for r in R.with_audio(spark.createDataFrame(cases, kind), sr, 1000).collect()}
    kept = 0
    for rec, x, words, spans, a, b in cases:
        clip = np.array((x[a:b] + [0.0] * (b - a))[: b - a], np.float32)
        frames = [np.sqrt(np.mean(np.square(clip[i : i + 20].astype(float)))) for i in range(0, len(clip) - 19, 10)]
        bound = max(1e-3, 0.1 * np.percentile(frames, 95))
        speech = max((10 * i + 20 for i, v in enumerate(frames) if v > bound), default=0)
        clip = clip[: max(min(len(clip), speech + 150), min(len(clip), words[-1][2] - a))].astype(float)
        rms = lambda v: np.sqrt(np.mean(np.square(v)))
        duration = len(clip) / sr
        left = [(s, min(e, a + len(clip))) for s, e in spans]
        left = [((s - a) / 1000, (e - a) / 1000) for s, e in left if e > s]
        loud = rms(clip) > 1e-3 and rms(clip[-50:]) > max(0.04, 0.4 * rms(clip))
        if loud or not left or duration - left[-1][0] < 0.08:
            assert rec not in got
            continue
        kept += 1
        r = got[rec]
        assert len(r.audio) == len(clip) and r.duration == duration and [tuple(s) for s in r.spans] == [*left[:-1], (left[-1][0], duration)]
        assert [w.start for w in r.words] == [(w[1] - a) / 1000 for w in words] and r.messages[0].content == "a b"
    assert 0 < kept < len(cases)


def test_vad_end_is_linear(spark):
    """Ten times the samples take at most about ten times as long."""
    import time

    from pyspark.sql import functions as F

    from cadenza.functions import waves as W

    def seconds(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(i * 0.1)).alias("x"))
        W_end = df.select(W.vad_end(F.col("x"), 320, 160).alias("e"))
        began = time.time()
        assert W_end.first().e == (n - 320) // 160 * 160 + 320
        return time.time() - began

    seconds(16_000)
    one, ten = min(seconds(16_000) for _ in range(2)), min(seconds(160_000) for _ in range(2))
    assert ten < 12 * one + 3


def test_lists_that_are_not_asked_for_are_not_made(spark):
    for name in ("turn_sentence", "turn_sentence_gap_fallback", "lead_window", "eot_window"):
        assert "collect_list" not in turns.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString(), name


@pytest.mark.parametrize("least", [(1, 0), (2, 1)])
def test_spans_as_rows_equal_spans_in_turns(spark, least):
    from cadenza.operators import examples as E

    rng = random.Random(11)
    cfg = TurnConfig(mode="sentence", min_words=least[0], min_hold_spans=least[1])
    recs = []
    for rec in range(40):
        at = 0
        for k in range(rng.randrange(1, 15)):
            at = max(0, at + rng.choice([-150, -50, 0, 60, 100, 300, 700]))
            recs.append((rec, k, f"w{k}" + rng.choice(["", "", ".."]), at, at + rng.choice([0, 100, 250])))
            at = recs[-1][4]
    df = spark.createDataFrame(recs, WORDS)
    nested = O.turns(df, cfg)
    got = {tuple(r) for r in O.spans(df, cfg).select("rec", "turn_index", "span_index", "n_spans", "start", "end").collect()}
    want = {(r.rec, r.turn_index, i, len(r.spans), *s) for r in nested.collect() for i, s in enumerate(r.spans)}
    assert got == want and len(got) > 40
    name = F.concat_ws(":", "rec", "turn_index").alias("id")
    times = sorted(map(tuple, E.query_times(nested.select(name, "spans"), 50, 100).collect()))
    assert sorted(map(tuple, E.span_times(O.spans(df, cfg), 50, 100).select(name, "time").collect())) == times
    sec = lambda c, *more: F.transform(c, lambda x: F.struct(*more and (x[m].alias(m) for m in more), (x["start"] / 1000).alias("start"), (x["end"] / 1000).alias("end")))
    marks = E.markers(nested.select(name, sec("spans").alias("spans"), sec("words", "word").alias("words"), (F.col("window_end") / 1000).alias("duration")))
    rows = E.marker_rows(O.spoken(df, cfg)).select(name, "k", (F.col("end_time") / 1000).alias("end_sec"), "marker", "transcript")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, marks.collect()))
    asked = E.prediction_rows(O.spoken(df, cfg), 50, 100, 1000, 16000, lambda t, end, prior: prior).orderBy("rec", "turn_index", "i").collect()
    turn = {(r.rec, r.turn_index): r for r in nested.collect()}
    assert len(asked) >= len(times)
    for r in asked:
        assert r.p_eot == sum(w.end <= round(r.timestamp * 1000) - 500 for w in turn[r.rec, r.turn_index].words)


@pytest.mark.parametrize("least", [(1, 0), (2, 1)])
def test_assembled_as_rows_equals_assembled(spark, least):
    """Also where words overlap, so that spans collapse or the last hold becomes the end of turn."""
    rng = random.Random(19)
    cfg = TurnConfig(mode="sentence", min_words=least[0], min_hold_spans=least[1], eot_trailing=0.05)
    recs = []
    for rec in range(60):
        at = 0
        for k in range(rng.randrange(1, 15)):
            at = max(0, at + rng.choice([-150, -50, 0, 60, 100, 300, 700]))
            recs.append((rec, k, rng.choice(["", " ", None, f"w{k}", f"w{k}", f"w{k}.."]), at, at + rng.choice([0, 100, 250])))
            at = recs[-1][4]
    df = spark.createDataFrame(recs, WORDS)
    for bound in (0, 80, 120):
        nested = R.assembled(O.turns(df, cfg), bound).select("rec", "turn_index", "duration", F.size("spans").alias("n_spans"), F.element_at("spans", -1)["start"].alias("eot_start"), F.element_at("words", 1)["start"].alias("first_word"), F.col("messages")[0]["content"].alias("content"))
        want = sorted(map(tuple, nested.collect()))
        assert sorted(map(tuple, R.assembled_rows(df, cfg, bound).select(nested.columns).collect())) == want and want


@pytest.mark.parametrize("name", ["row_assembly", "marker_expand"])
def test_words_in_order_are_sorted_twice_and_not_listed(spark, name):
    """Once by recording, once by turn; texts of a turn are strings, and only turns whose words end out of order have lists."""
    from cadenza import plans

    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1
    last, *others = [line for line in plan.splitlines() if "Window [" in line]  # what a window gives is held by those after it, for each word
    assert "listagg(" in last and not any("listagg(" in x for x in others)
