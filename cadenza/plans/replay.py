"""Replays of conversations as recordings: latch, gates, ends of turn and captions.

A word is three loud frames for each character; the pause after it is longer after a sentence.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.text import sentence_end
from cadenza.plans.turns import sentence_sql
from cadenza.sources import adapters as A
from cadenza.streaming import fold as S


def recordings(spark, sf_dir):
    """Each conversation's turns, one after another."""
    words = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")
    gap = lambda w: F.floor((40 + (37 * F.length(w)) % 200 + F.when(sentence_end(w), 600).otherwise(0)) / 20).cast("int")
    frames = F.array_join(F.transform(words, lambda w: S.frames_of(3 * F.length(w), gap(w))), "")
    told = A.table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    # texts are dealt, not frames: these are long and shrink to nothing in a shuffle, so that sizes would put all into a few tasks
    turns = told.repartition(A.partitions(told, 1 << 20), "conv_id").select("conv_id", "turn", frames.alias("frames"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "frames"))), lambda x: x["frames"]), "")
    return turns.groupBy(F.col("conv_id").alias("session")).agg(whole.alias("frames"))


def events(spark, sf_dir):
    return S.replayed(recordings(spark, sf_dir))


def replay_events(spark, sf_dir):
    """What is told at the end of each chunk of 0.3 seconds."""
    return events(spark, sf_dir).select("session", "k", F.round("t", 6).alias("t"), "silent", F.round("p_eot", 9).alias("p_eot"), "status")


def speech_latch(spark, sf_dir):
    """When speech is latched for each turn: the first chunk after the last end of turn that holds a sustained run."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).where("status <> 'end_of_turn (end of recording)'")
    before = F.lag("has_speech", 1, False).over(Window.partitionBy("session").orderBy("k"))
    ended = F.lag(F.col("status").startswith("end_of_turn"), 1, False).over(Window.partitionBy("session").orderBy("k"))
    return e.withColumn("_new", F.col("has_speech") & (~before | ended)).where("_new").select("session", "k")


def score_gating(spark, sf_dir):
    """Chunks by what is done with them."""
    return events(spark, sf_dir).groupBy("session", "status").agg(F.count("*").alias("n"), F.max("silent").alias("most_silent"))


def turn_captions(spark, sf_dir):
    c = S.captions(events(spark, sf_dir))
    return c.select("session", "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


QUERIES = {f.__name__: f for f in (replay_events, speech_latch, score_gating, turn_captions)}
EVENTS = f"""words AS (
  SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS ws FROM conversations WHERE text IS NOT NULL)),
recordings AS (
  SELECT conv_id AS session,
         string_agg(repeat('1', 3 * length(word)) || repeat('0', ((40 + (37 * length(word)) % 200 + CASE WHEN {sentence_sql('word')} THEN 600 ELSE 0 END) // 20)::INT), '' ORDER BY turn, pos) AS f
  FROM words GROUP BY conv_id),
parts AS (SELECT session, length(f) AS n, k::INT AS k, substring(f, 15 * k + 1, 15) AS c FROM (SELECT session, f, unnest(range(0, (length(f) + 14) // 15)) AS k FROM recordings)),
features AS (
  SELECT *, length(c) AS size, contains(c, '1') AS loud, contains(c, '0') AS quiet, length(c) - length(rtrim(c, '0')) AS tail, length(c) - length(ltrim(c, '1')) AS lead_run,
         length(c) - length(rtrim(c, '1')) AS last_run, list_max(list_transform(string_split_regex(c, '0+'), lambda x: length(x))) AS longest FROM parts),
heard AS (
  SELECT session, -1 AS k, 0::BIGINT AS n, 0::BIGINT AS silent, false AS has_speech, 'listening' AS status, 0::BIGINT AS next_silent, 0::BIGINT AS run, false AS latched FROM recordings
  UNION ALL
  SELECT session, k, n, silent, has_speech, status, CASE WHEN starts_with(status, 'end') THEN 0 ELSE silent END, CASE WHEN starts_with(status, 'end') THEN 0 ELSE run END, has_speech AND NOT starts_with(status, 'end')
  FROM (SELECT *, CASE WHEN NOT has_speech OR silent < 5 THEN 'listening' WHEN silent >= 150 THEN 'end_of_turn (timeout)'
                       WHEN silent >= 10 AND 1 - exp(-(silent * 0.02::DOUBLE) / 0.6::DOUBLE) >= 0.5 THEN 'end_of_turn' ELSE 'holding' END AS status
        FROM (SELECT f.session, f.k, f.n, least(CASE WHEN loud THEN tail ELSE h.next_silent + size END, 1500) AS silent, CASE WHEN quiet THEN last_run ELSE h.run + size END AS run,
                     h.latched OR h.run + lead_run >= 10 OR longest >= 10 AS has_speech
              FROM heard h JOIN features f ON f.session = h.session AND f.k = h.k + 1))),
events AS (
  SELECT session, k, (k + 1) * 0.3::DOUBLE AS t, silent::INT AS silent, has_speech, CASE WHEN status = 'listening' THEN 0.0::DOUBLE ELSE 1 - exp(-(silent * 0.02::DOUBLE) / 0.6::DOUBLE) END AS p_eot, status FROM heard WHERE k >= 0
  UNION ALL
  SELECT session, k + 1, n * 0.02::DOUBLE, silent::INT, has_speech, 0.0::DOUBLE, 'end_of_turn (end of recording)' FROM heard
  WHERE k >= 0 AND k = (n + 14) // 15 - 1 AND has_speech AND silent > 0 AND NOT starts_with(status, 'end'))"""
SQL = {
    "replay_events": f"WITH RECURSIVE {EVENTS} SELECT session, k, round(t, 6) AS t, silent, round(p_eot, 9) AS p_eot, status FROM events",
    "speech_latch": f"""WITH RECURSIVE {EVENTS} SELECT session, k FROM (
  SELECT session, k, has_speech, lag(has_speech, 1, false) OVER w AS before, lag(starts_with(status, 'end'), 1, false) OVER w AS ended FROM events WHERE status <> 'end_of_turn (end of recording)'
  WINDOW w AS (PARTITION BY session ORDER BY k)) WHERE has_speech AND (NOT before OR ended)""",
    "score_gating": f"WITH RECURSIVE {EVENTS} SELECT session, status, count(*) AS n, max(silent) AS most_silent FROM events GROUP BY session, status",
    "turn_captions": f"""WITH RECURSIVE {EVENTS} SELECT session, 'EOT #' || row_number() OVER (PARTITION BY session ORDER BY k) AS text, round(greatest(0, t - 0.1), 6) AS start, round(t + 0.1, 6) AS "end"
FROM events WHERE starts_with(status, 'end_of_turn')""",
}
