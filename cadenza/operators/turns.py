"""Words to turns with ordered silence spans.

A words table has ``rec`` (the recording), ``pos`` (order among equal times), ``word``, and
integer ``start`` and ``end``; ``audio_end`` (the recording's length), ``mode`` (its mode, instead of the configured one) and
``ends`` (whether the word ends a sentence) are optional. One shuffle by recording serves
the neighbours, the boundaries and the grouping, whose keys refine it. ``order``: what puts a recording's words in the order of ``ORDER``; words made in order
need no second sort if it is said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import TurnConfig
from cadenza.functions.text import sentence_end

ORDER = ("start", "end", "pos")


def with_gaps(words: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Each word with the end before it, the start after it, and the raw gap after it (it may be negative)."""
    w = Window.partitionBy("rec").orderBy(*order)
    near = words.where(F.col("end") >= F.col("start")).withColumn("prev_end", F.lag("end").over(w)).withColumn("next_start", F.lead("start").over(w))
    return near.withColumn("gap", F.col("next_start") - F.col("end"))


def gaps(words: DataFrame) -> DataFrame:
    """Gaps between neighbours, not below zero."""
    return with_gaps(words).where("gap IS NOT NULL").withColumn("gap", F.greatest(F.col("gap"), F.lit(0)))


def boundary(cfg: TurnConfig, ends: Column | None = None, mode: Column | None = None) -> Column:
    """Does a turn end after this word (the last word always ends one)? ends: what is known of sentence ends; mode: one for each row instead of cfg's."""
    wide = F.coalesce(F.col("gap") >= cfg.tick("turn_gap"), F.lit(False))
    by_mode = {"single": F.lit(False), "segment": wide, "sentence": wide | (sentence_end(F.col("word")) if ends is None else ends)}
    if mode is None:
        return by_mode[cfg.mode]
    return F.when(mode == "single", by_mode["single"]).when(mode == "segment", by_mode["segment"]).when(mode == "sentence", by_mode["sentence"])


def segmented(words: DataFrame, cfg: TurnConfig, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Words with ``turn``, the number of boundaries before each, ``opens``, ``closes``, and ``hold``: is a silence after it within its turn."""
    t = cfg.tick
    w = Window.partitionBy("rec").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    known = {x: F.col(x) for x in ("ends", "mode") if x in words.columns}
    cut = with_gaps(words, order).withColumn("cut", boundary(cfg, **known))
    turn = F.coalesce(F.sum(F.col("cut").cast("int")).over(before), F.lit(0))
    rows = cut.withColumn("turn", turn.cast("long")).withColumn("opens", F.lag("cut", 1, True).over(w)).withColumn("closes", F.col("cut") | F.col("next_start").isNull())
    hold = ~F.col("closes") & (F.col("gap") >= t("min_silence"))
    if "mode" in words.columns:
        hold = hold & ((F.col("mode") == "single") | (F.col("gap") < t("turn_gap")))
    elif cfg.mode != "single":
        hold = hold & (F.col("gap") < t("turn_gap"))
    return rows.withColumn("hold", F.coalesce(hold, F.lit(False)))


def window_end(cfg: TurnConfig, last_end: Column, next_start: Column, audio_end: Column) -> Column:
    """Where the window of a turn ends, from its last word's end, the next word's start and the recording's length."""
    t = cfg.tick
    inner = F.greatest(F.lit(0), F.least(next_start - last_end, F.lit(t("max_trailing"))) - t("eot_guard"))
    final = F.least(F.greatest(F.coalesce(audio_end - last_end, F.lit(0)), F.lit(t("eot_trailing"))), F.lit(t("max_trailing")))
    return last_end + F.when(next_start.isNotNull(), inner).otherwise(final)


def audio_end(words: DataFrame) -> Column:
    return F.col("audio_end") if "audio_end" in words.columns else F.lit(None).cast("long")


def turns(words: DataFrame, cfg: TurnConfig) -> DataFrame:
    """One row per turn: turn_index, words, spans (holds, then the end of turn), their counts, hold_total, window_start, window_end.

    Neighbours come from all words, also those of turns that the filters drop; survivors are numbered from 0. Lists that are
    not asked for are not made: counts and sums come from the words themselves.
    """
    t = cfg.tick
    seg = segmented(words, cfg)
    ordered = F.struct(*ORDER, "word")
    rows = seg.withColumn("_audio_end", audio_end(words)).groupBy("rec", "turn").agg(
        F.sort_array(F.collect_list(ordered)).alias("words"),
        F.sort_array(F.collect_list(F.when(F.col("hold"), F.struct(F.col("end").alias("start"), F.col("next_start").alias("end"))))).alias("holds"),
        F.count("*").cast("int").alias("n_words"),
        F.count(F.when(F.col("hold"), 1)).cast("int").alias("n_holds"),
        F.coalesce(F.sum(F.when(F.col("hold"), F.col("gap"))), F.lit(0)).cast("long").alias("hold_total"),
        F.min("start").alias("start"),
        F.max(F.when(F.col("closes"), F.col("end"))).alias("last_end"),
        F.max(F.when(F.col("closes"), F.col("next_start"))).alias("next_start"),
        F.max(F.when(F.col("opens"), F.col("prev_end"))).alias("prev_end"),
        F.max("_audio_end").alias("audio_end"),
    )
    lead = F.col("start") - F.greatest(F.lit(0), F.least(F.lit(t("lead_in")), F.col("start") - F.col("prev_end")) - t("eot_guard"))
    rows = rows.withColumn("window_start", F.when(F.col("prev_end").isNotNull(), lead).otherwise(F.greatest(F.lit(0), F.col("start") - t("lead_in"))))
    rows = rows.withColumn("window_end", window_end(cfg, F.col("last_end"), F.col("next_start"), F.col("audio_end")))
    rows = rows.withColumn("spans", F.concat("holds", F.array(F.struct(F.col("last_end").alias("start"), F.col("window_end").alias("end")))))
    rows = rows.where((F.col("n_words") >= cfg.min_words) & (F.col("n_holds") >= cfg.min_hold_spans))
    number = F.row_number().over(Window.partitionBy("rec").orderBy("turn")) - 1
    return rows.withColumn("turn_index", number).select("rec", "turn_index", "turn", "words", "spans", "n_words", "n_holds", "hold_total", "start", "last_end", "window_start", "window_end")


def spoken(words: DataFrame, cfg: TurnConfig, order: tuple[str, ...] = ORDER, also: tuple[str, ...] = ()) -> DataFrame:
    """The words of ``turns`` as rows: rec, turn_index, pos, word, start, end; where a silence span follows, ``silence`` is its end, and ``closes`` tells the end of turn from holds.

    also: more columns of ``segmented``.
    """
    rows = segmented(words, cfg, order)
    rows = rows.withColumn("silence", F.when(F.col("closes"), window_end(cfg, F.col("end"), F.col("next_start"), audio_end(words))).when(F.col("hold"), F.col("next_start")))
    if cfg.min_words > 1 or cfg.min_hold_spans > 0:
        whole = Window.partitionBy("rec", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_words", F.count("*").over(whole)).withColumn("_holds", F.count(F.when(F.col("hold"), 1)).over(whole))
        rows = rows.where((F.col("_words") >= cfg.min_words) & (F.col("_holds") >= cfg.min_hold_spans))
        rows = rows.withColumn("turn_index", F.dense_rank().over(Window.partitionBy("rec").orderBy("turn")) - 1)
    else:  # turns are numbered without holes
        rows = rows.withColumn("turn_index", F.col("turn"))
    return rows.select("rec", F.col("turn_index").cast("int").alias("turn_index"), "pos", "word", "start", "end", "silence", "closes", *also)


def spans(words: DataFrame, cfg: TurnConfig, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The spans of ``turns`` as rows, without a list: rec, turn_index, span_index, n_spans, start, end, closes."""
    turn = Window.partitionBy("rec", "turn_index").orderBy(*order)
    rows = spoken(words, cfg, order).where("silence IS NOT NULL").withColumn("span_index", F.row_number().over(turn) - 1)
    rows = rows.withColumn("n_spans", F.count("*").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("rec", "turn_index", "span_index", F.col("n_spans").cast("int").alias("n_spans"), F.col("end").alias("start"), F.col("silence").alias("end"), "closes")


def row_id(language: Column, source: Column, index: Column) -> Column:
    return F.format_string("%s__%s__turn_%03d", language, source, index)
