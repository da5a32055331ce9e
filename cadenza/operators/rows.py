"""Turns to finished rows: times counted from the window, checks of the clip's tail, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import waves as W
from cadenza.config import TurnConfig
from cadenza.functions.text import transcript
from cadenza.operators.turns import ORDER, row_id, spoken, turns

LEAST_EOT = 0.08
#: Seconds of silence kept after speech, of the tail that is checked, and of a frame and its hop; the tail's loudness against the clip's.
TAIL_PAD, TAIL, FRAME, HOP, TAIL_RATIO = 0.15, 0.05, 0.02, 0.01, 0.4


def clipped_spans(spans: Column, window_start: Column, duration: Column, least: float | int = LEAST_EOT) -> Column:
    """Spans from the window's start, within the clip, empty ones dropped, the last one up to the clip's end.

    Null where none is left or the last one is shorter than ``least``. If the end of turn
    collapses, the last hold that is left becomes it.
    """
    moved = F.transform(spans, lambda s: F.struct((s["start"] - window_start).alias("start"), F.least(s["end"] - window_start, duration).alias("end")))
    some = F.filter(moved, lambda s: s["end"] > s["start"])
    n = F.size(some)
    last = F.element_at(some, -1)
    out = F.concat(F.slice(some, F.lit(1), n - 1), F.array(F.struct(last["start"].alias("start"), duration.alias("end"))))
    return F.when(n > 0, F.when(duration - last["start"] >= least, out))


def assembled(turns: DataFrame, least: float | int = LEAST_EOT) -> DataFrame:
    """Rows of turns (words, spans, window_start, window_end) with times from the window: duration, spans, words, messages."""
    duration = F.col("window_end") - F.col("window_start")
    rows = turns.withColumn("duration", duration).withColumn("spans", clipped_spans(F.col("spans"), F.col("window_start"), F.col("duration"), least)).where("spans IS NOT NULL")
    moved = F.transform("words", lambda w: F.struct(w["word"].alias("word"), (w["start"] - F.col("window_start")).alias("start"), (w["end"] - F.col("window_start")).alias("end")))
    rows = rows.withColumn("words", moved)
    return rows.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), transcript(F.col("words")).alias("content"))))


def assembled_rows(words: DataFrame, cfg: TurnConfig, least: float | int = LEAST_EOT, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``assembled`` of the turns of words, without lists of them: rec, turn_index, duration, n_spans, eot_start, first_word, content.

    A span is left if it starts before the window's end; holds and the end of turn are known at its words, and one row a turn leaves.
    """
    own = Window.partitionBy("rec", "turn_index").orderBy(*order)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = cfg.tick
    rows = spoken(words, cfg, order, ("opens", "prev_end"))
    first, before = F.min("start").over(whole), F.max(F.when(F.col("opens"), F.col("prev_end"))).over(whole)
    rows = rows.withColumn("_first", first).withColumn("_before", before).withColumn("_end", F.max(F.when(F.col("closes"), F.col("silence"))).over(whole))
    left = F.col("silence").isNotNull() & (F.least("silence", "_end") > F.col("end"))
    rows = rows.withColumn("n_spans", F.count(F.when(left, 1)).over(whole)).withColumn("_hold", F.max(F.when(left & ~F.col("closes"), F.col("end"))).over(whole))
    word = F.when(F.col("_end").isNotNull(), F.col("word"))  # so that no window comes after that of the text, and holds it for each word
    rows = rows.withColumn("content", F.trim(F.coalesce(F.listagg(word, F.lit(" ")).over(whole), F.lit("")))).where("closes")
    lead = F.col("_first") - F.greatest(F.lit(0), F.least(F.lit(t("lead_in")), F.col("_first") - F.col("_before")) - t("eot_guard"))
    start = F.when(F.col("_before").isNotNull(), lead).otherwise(F.greatest(F.lit(0), F.col("_first") - t("lead_in")))
    rows = rows.withColumn("_start", start).withColumn("_last", F.when(left, F.col("end")).otherwise(F.col("_hold"))).where((F.col("n_spans") > 0) & (F.col("_end") - F.col("_last") >= least))
    return rows.select("rec", "turn_index", (F.col("_end") - F.col("_start")).alias("duration"), F.col("n_spans").cast("int").alias("n_spans"), (F.col("_last") - F.col("_start")).alias("eot_start"), (F.col("_first") - F.col("_start")).alias("first_word"), "content")


def loud_tail(clip_rms: Column, tail_rms: Column, ratio: float = 0.4) -> Column:
    """Is the end of the clip still speech?"""
    return (clip_rms > 1e-3) & (tail_rms > F.greatest(F.lit(0.04), ratio * clip_rms))


def samples(seconds: Column, sr: int) -> Column:
    return F.rint(seconds * sr).cast("int")


def trimmed(clip: Column, last_word: Column, sr: int, pad: float = TAIL_PAD, frame: float = FRAME, hop: float = HOP) -> Column:
    """A clip up to so many seconds after its speech ends, but not into its last word, whose end is given in samples."""
    size = F.size(clip)
    speech = W.vad_end(clip, int(sr * frame), int(sr * hop))
    end = F.greatest(F.least(size, speech + round(pad * sr)), F.least(size, last_word))
    return F.slice(clip, F.lit(1), F.greatest(end, F.lit(0)))


def with_audio(turns: DataFrame, sr: int, ticks: int, audio: str = "audio", trim: bool = True, ratio: float = TAIL_RATIO, pad: float = TAIL_PAD, tail: float = TAIL, frame: float = FRAME, hop: float = HOP) -> DataFrame:
    """Rows of turns (integer ticks) whose recording's samples lie in ``audio``: the clip takes its place, times are seconds from the clip's start.

    The clip is the turn's window, padded with zeros where the recording is shorter, its tail trimmed to silence. Turns whose
    clip is still loud at its end, and those without an end of turn of ``LEAST_EOT`` seconds, are dropped.
    """
    sec = lambda c: c / F.lit(float(ticks))
    first, last = samples(sec(F.col("window_start")), sr), samples(sec(F.col("window_end")), sr)
    word = samples(sec(F.element_at("words", -1)["end"] - F.col("window_start")), sr)
    rows = turns.withColumn(audio, W.cut(F.col(audio), first, last))
    if trim:
        rows = rows.withColumn(audio, trimmed(F.col(audio), word, sr, pad, frame, hop))
    clip = F.col(audio)
    quiet = W.let(clip, lambda x: ~loud_tail(W.rms(x), W.rms(W.recent(x, F.lit(round(tail * sr)))), ratio))
    rows = rows.where((F.size(audio) == 0) | quiet).withColumn("duration", F.size(audio) / F.lit(float(sr)))
    ms = lambda c: F.round(c, 3)
    start = F.col("window_start")
    moved = F.transform("spans", lambda s: F.struct(ms(sec(s["start"] - start)).alias("start"), ms(F.least(sec(s["end"] - start), F.col("duration"))).alias("end")))
    some = F.filter(moved, lambda s: s["end"] > s["start"])
    ended = F.concat(F.slice(some, F.lit(1), F.greatest(F.size(some) - 1, F.lit(0))), F.array(F.struct(F.element_at(some, -1)["start"].alias("start"), ms(F.col("duration")).alias("end"))))
    rows = rows.withColumn("spans", F.when(F.size(some) > 0, ended)).where("spans IS NOT NULL")
    rows = rows.where(F.element_at("spans", -1)["end"] - F.element_at("spans", -1)["start"] >= LEAST_EOT)
    words = F.transform("words", lambda w: F.struct(w["word"].alias("word"), ms(sec(w["start"] - start)).alias("start"), ms(sec(w["end"] - start)).alias("end")))
    rows = rows.withColumn("words", words)
    return rows.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), transcript(F.col("words")).alias("content"))))


def built(recordings: DataFrame, cfg, sr: int, mode: str = "auto", **audio) -> DataFrame:
    """Recordings (rec, language, sr, audio, words with integer times, mode) to finished rows: resampled, cut into turns, named and assembled.

    mode ``auto`` takes each recording's own mode, another holds for all. Words travel without the audio, which meets its turns once they are built.
    """
    whole = F.rint(F.size("audio") * F.lit(float(sr)) / F.col("sr")).cast("int")
    even = F.when(F.col("sr") == sr, F.col("audio").cast("array<double>")).otherwise(W.resampled(F.col("audio"), whole))
    own = recordings.select("rec", "language", "words", F.col("mode") if mode == "auto" else F.lit(mode).alias("mode"), even.alias("audio"))
    length = F.rint(F.size("audio") * F.lit(float(cfg.ticks)) / F.lit(float(sr))).cast("long")
    words = own.select("rec", "mode", length.alias("audio_end"), F.posexplode("words").alias("pos", "w"))
    words = words.select("rec", "mode", "audio_end", F.col("pos").cast("long").alias("pos"), "w.word", "w.start", "w.end")
    made = turns(words, cfg).join(own.select("rec", "language", "audio"), "rec")
    return with_audio(made, sr, cfg.ticks, **audio).withColumn("id", row_id(F.col("language"), F.col("rec").cast("string"), F.col("turn_index")))
