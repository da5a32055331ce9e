"""What serving and training ask of finished rows: filters, cuts, prompts, records, histories, modes and clips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.config import TurnConfig
from cadenza.functions import audio as AU
from cadenza.functions import text as T
from cadenza.functions import waves as W
from cadenza.operators import examples as E
from cadenza.operators import rows as R
from cadenza.operators import turns as O
from cadenza.plans import examples as X
from cadenza.plans import turns as P
from cadenza.plans import waves as V
from cadenza.sources import adapters as A

FINAL = TurnConfig(mode="segment", **P.EVENTS)
AUTO = TurnConfig(**P.WORDS)
MODE_OF = {0: "single", 1: "segment", 2: "sentence"}


def documents(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


def language_allow_list(spark, sf_dir):
    return E.allowed(documents(spark, sf_dir), ("de", "en"), "lang").select("doc_id", "lang")


def length_filters(spark, sf_dir):
    """Clips under 320 samples, without audio tokens, or beyond a block are dropped."""
    n = F.col("n_chars")
    examples = documents(spark, sf_dir).select("doc_id", (n * 3).alias("n_samples"), T.audio_tokens(n - 150).alias("n_audio"), F.floor(n / 2).alias("n_tokens"))
    return E.usable(examples)


def long_audio_drop(spark, sf_dir):
    """A window of 45 seconds, of which 30 fit."""
    n = F.col("n_chars") * 160
    return E.short_enough(documents(spark, sf_dir), n, 16_000, 45.0).select("doc_id", n.alias("n_samples"))


def query_cut_sample(spark, sf_dir):
    grid = E.span_times(X.spans(spark, sf_dir), 500, 100)
    return grid.select(X.turn_id(), "time", E.sample_at(F.col("time") / 1000, X.RATE).alias("end_sample"))


def turn_prediction_record(spark, sf_dir):
    """Records of all turns, an event a row: the score is made of the samples and the words that a query sees."""
    words = O.spoken(P.words_of(spark, sf_dir, "documents"), P.SENTENCE, A.TEXT_ORDER)
    rows = E.prediction_rows(words, 500, 100, 1000, X.RATE, lambda t, end, prior: (end % 97) / 97.0 + prior)
    return rows.select(X.turn_id(), "audio_sec", "n_events", "i", "timestamp", F.col("label").cast("long").alias("label"), F.round("silence", 6).alias("silence"), F.round("p_eot", 9).alias("p_eot"))


def example_predictions(spark, sf_dir):
    """Examples and the predictions that are there for them, paired by numbers: names are made for what is left."""
    examples = X.points(spark, sf_dir).select("rec", "turn_index", "span_index", "cut_index", "cut_sample", "label")
    predictions = examples.where("cut_index < 2").withColumn("p_eot", (F.col("cut_sample") % 1000) / 1000)
    out = E.scored(examples.drop("cut_sample"), predictions, ("rec", "turn_index", "span_index", "cut_index"))
    return out.select(X.turn_id(), F.col("span_index").cast("long").alias("span_index"), F.col("cut_index").cast("long").alias("cut_index"), "label", "p_eot")


def serving_prompt(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(E.serving_prompt(T.char_codes, X.SPECIAL, (F.col("turn") % 8).cast("int"), "be brief"), ",").alias("ids"))


def history_eviction(spark, sf_dir):
    """A user's events of the last three days, and no more than five."""
    points = A.event_words(A.table(spark, sf_dir, "events")).select("rec", "pos", F.col("start").alias("t"))
    return E.histories(points, "rec", "t", 3 * 86_400 * 1_000_000, 5).select("rec", "pos", "kept")


def turn_auto_mode(spark, sf_dir):
    """Each recording in its own mode."""
    mode = F.when(F.col("rec") % 3 == 0, MODE_OF[0]).when(F.col("rec") % 3 == 1, MODE_OF[1]).otherwise(MODE_OF[2])
    return P.flat(O.turns(A.text_words(documents(spark, sf_dir)).withColumn("mode", mode), AUTO))


def turn_final_audio_end(spark, sf_dir):
    """The last turn's end of turn lasts as long as the recording lets it."""
    words = A.event_words(A.table(spark, sf_dir, "events"))
    end = F.max("end").over(Window.partitionBy("rec")) + (F.col("rec") % 5) * 300_000
    return P.flat(O.turns(words.withColumn("audio_end", end.cast("long")), FINAL))


def tail_trim(spark, sf_dir):
    """Clips without what follows the speech, at 64 samples a second: the end, and what is left at it."""
    clip = R.trimmed(F.col("x"), (F.col("id") % 64).cast("int"), 64, pad=0.15, frame=0.0625, hop=0.03125)
    return V.waves(spark, sf_dir).withColumn("x", F.transform("x", lambda v, i: F.when(i < F.col("id") % 50, v.cast("double")).otherwise(v.cast("double") * 1e-3))).select("id", F.size(clip).cast("long").alias("n"))


def recordings(spark, sf_dir):
    """A second of sound for each vector, loud while one of three words is said."""
    start = lambda k: (F.lit(60 + 300 * k) + F.col("id") % 40).cast("long")
    words = F.array(*(F.struct(F.lit(w).alias("word"), start(k).alias("start"), (start(k) + 100 + 10 * (F.col("id") % 3)).cast("long").alias("end")) for k, w in enumerate(("one", "two.", "three"))))
    said = lambda i: F.exists("words", lambda w: (w["start"] <= i * 15.625) & (i * 15.625 < w["end"]))
    rows = V.waves(spark, sf_dir).withColumn("words", words)
    audio = F.transform("x", lambda v, i: v.cast("double") * F.when(said(i), 1.0).otherwise(1e-3))
    mode = F.when(F.col("id") % 2 == 0, "single").otherwise("sentence")
    return rows.select(F.col("id").alias("rec"), F.lit("en").alias("language"), F.lit(64).alias("sr"), "words", audio.alias("audio"), mode.alias("mode"))


def build_rows(spark, sf_dir):
    """Sound and words to rows with their clips, each recording in its own mode."""
    cfg = TurnConfig(min_silence=0.1, turn_gap=0.7)
    rows = R.built(recordings(spark, sf_dir), cfg, 64, tail=0.05, frame=0.0625, hop=0.03125)
    last = F.element_at("spans", -1)
    return rows.select("id", F.size("audio").cast("long").alias("n_samples"), F.round("duration", 6).alias("duration"), F.size("spans").cast("long").alias("n_spans"), last["start"].alias("eot_start"), last["end"].alias("eot_end"), F.element_at("words", 1)["start"].alias("first_word"), F.col("messages")[0]["content"].alias("content"))


def synthetic_signal(spark, sf_dir):
    x = E.noise(documents(spark, sf_dir).select("doc_id", "n_chars"), F.col("n_chars") / 100, 16, 7)
    return x.select("doc_id", F.size("audio").cast("long").alias("n"), F.forall("audio", lambda v: F.abs(v) < 0.5).alias("bounded"))


def wav_round_trip(spark, sf_dir):
    """Samples to 16-bit WAV bytes and back."""
    x = V.waves(spark, sf_dir).select("id", AU.wav_samples(AU.wav_bytes(F.col("x"), F.lit(64))).alias("w"))
    return x.select("id", "w.rate", F.posexplode("w.samples").alias("i", "y")).select("id", F.col("rate").cast("long").alias("rate"), F.col("i").cast("long").alias("i"), F.round(F.col("y").cast("double") * 32767).cast("long").alias("code"))


def int16_range(spark, sf_dir):
    """Every other clip is given in the range of 16-bit integers."""
    x = F.transform("x", lambda v: v.cast("double") * F.when(F.col("id") % 2 == 1, 20_000).otherwise(1))
    return V.waves(spark, sf_dir).select("id", V.summed(F.transform(W.from_int16(x), F.abs)).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (language_allow_list, length_filters, long_audio_drop, query_cut_sample, turn_prediction_record, example_predictions, serving_prompt, history_eviction, turn_auto_mode, turn_final_audio_end, tail_trim, build_rows, synthetic_signal, wav_round_trip, int16_range)
}

SPANS = f"""{P.SENTENCE_SQL},
spans AS (
  SELECT t.rec, t.turn, t.window_end, t.rec || ':' || t.turn_index AS id, o.e AS s, o.next_start AS e, 0 AS label FROM opened o JOIN turns t ON o.rec = t.rec AND o.turn = t.turn WHERE o.hold
  UNION ALL SELECT rec, turn, window_end, rec || ':' || turn_index, last_end, window_end, 1 FROM turns),
asked AS (SELECT *, unnest(range(s, e + 1, 500)) AS t FROM spans WHERE e - s >= 100)"""
VAD = """f AS (SELECT id, k, x[k * 2 + 1:k * 2 + 4] AS f FROM (SELECT id, x, len(x) AS n, unnest(range((len(x) - 4) // 2 + 1)) AS k FROM clips WHERE len(x) >= 4)),
r AS (SELECT id, k, sqrt(list_sum(list_transform(f, lambda v: v * v)) / len(f)) AS rms FROM f),
b AS (SELECT id, greatest(1e-3, 0.1 * quantile_cont(rms, 0.95)) AS bound FROM r GROUP BY id),
speech AS (SELECT r.id, coalesce(max(CASE WHEN rms > bound THEN k * 2 + 4 END), 0) AS speech FROM r JOIN b ON r.id = b.id GROUP BY r.id)"""
BUILT_WORDS = """w AS (
  SELECT vec_id AS rec, k AS pos, ['one', 'two.', 'three'][k + 1] AS word, 60 + 300 * k + vec_id % 40 AS s, 160 + 300 * k + vec_id % 40 + 10 * (vec_id % 3) AS e
  FROM embeddings, range(3) r(k)),
sound AS (
  SELECT vec_id AS rec, list_transform(list_zip(embedding, range(64)), lambda p: p[1]::DOUBLE * CASE WHEN list_has_any([60 <= p[2] * 15.625 - vec_id % 40 AND p[2] * 15.625 < 160 + vec_id % 40 + 10 * (vec_id % 3),
    360 <= p[2] * 15.625 - vec_id % 40 AND p[2] * 15.625 < 460 + vec_id % 40 + 10 * (vec_id % 3), 660 <= p[2] * 15.625 - vec_id % 40 AND p[2] * 15.625 < 760 + vec_id % 40 + 10 * (vec_id % 3)], [true]) THEN 1.0::DOUBLE ELSE 1e-3 END) AS x
  FROM embeddings),
words AS (SELECT rec, pos, word, s, e, 1000 AS audio_end FROM w)"""
SQL = {
    "language_allow_list": "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'en')",
    "length_filters": """SELECT * FROM (SELECT doc_id, n_chars * 3 AS n_samples, CASE WHEN n_chars - 150 <= 0 THEN 0 ELSE (n_chars - 151) // 2 + 1 END AS n_audio, n_chars // 2 AS n_tokens FROM documents)
WHERE n_samples >= 320 AND n_audio > 0 AND n_tokens <= 2048""",
    "long_audio_drop": "SELECT doc_id, n_chars * 160 AS n_samples FROM documents WHERE least(n_chars * 160, 720000) / 16000 <= 30",
    "query_cut_sample": f"WITH {SPANS} SELECT DISTINCT id, t AS time, floor(t / 1000 * {X.RATE} + 1e-6::DOUBLE)::BIGINT AS end_sample FROM asked",
    "turn_prediction_record": f"""WITH {SPANS},
heard AS (
  SELECT a.id, a.t, a.s, a.label, a.window_end, count(CASE WHEN o.e <= a.t - 500 THEN 1 END) AS prior
  FROM asked a JOIN opened o ON o.rec = a.rec AND o.turn = a.turn GROUP BY ALL)
SELECT id, window_end / 1000 AS audio_sec, count(*) OVER (PARTITION BY id) AS n_events, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS i, t / 1000 AS timestamp, label::BIGINT AS label,
       round((t - s) / 1000, 6) AS silence, round((floor(t / 1000 * {X.RATE} + 1e-6::DOUBLE)::BIGINT % 97) / 97.0::DOUBLE + prior, 9) AS p_eot FROM heard""",
    "example_predictions": f"WITH {X.ROWS} SELECT id, span_index, cut_index, label, cut_sample % 1000 / 1000 AS p_eot FROM points WHERE cut_index < 2",
    "serving_prompt": f"""SELECT conv_id, turn, array_to_string(list_concat({X.fixed_ids('start', 'system\n', 'be brief', 'end', '\n', 'start', 'user\n', 'audio_bos')}, list_transform(range(turn % 8), lambda i: 1003),
  {X.fixed_ids('audio_eos', 'end', '\n', 'start', 'assistant\n')}), ',') AS ids FROM conversations""",
    "history_eviction": f"""WITH {P.EVENT_SQL}
SELECT rec, pos, least(count(*) OVER (PARTITION BY rec ORDER BY s RANGE BETWEEN {3 * 86_400 * 1_000_000} PRECEDING AND CURRENT ROW), 5) AS kept FROM words""",
    "turn_auto_mode": f"WITH {P.turn_ctes(P.TEXT_SQL, AUTO, mode='rec % 3')}\nSELECT {P.FLAT} FROM turns",
    "turn_final_audio_end": f"""WITH {P.turn_ctes(P.EVENT_SQL.replace("words AS (", "heard AS (") + ", words AS (SELECT *, max(e) OVER (PARTITION BY rec) + (rec % 5) * 300000 AS audio_end FROM heard)", FINAL, audio_end=True)}
SELECT {P.FLAT} FROM turns""",
    "tail_trim": f"""WITH {V.X},
clips AS (SELECT id, list_transform(list_zip(x, range(64)), lambda p: p[1] * CASE WHEN p[2] < id % 50 THEN 1.0::DOUBLE ELSE 1e-3 END) AS x FROM x),
{VAD}
SELECT id, greatest(least(64, speech + 10), least(64, id % 64))::BIGINT AS n FROM speech""",
    "build_rows": f"""WITH {P.turn_ctes(BUILT_WORDS, TurnConfig(min_silence=0.1, turn_gap=0.7), audio_end=True, mode='CASE WHEN rec % 2 = 0 THEN 0 ELSE 2 END')},
cut AS (
  SELECT t.rec || ':' || turn AS id, t.*, greatest(0, round_even(window_start / 1000 * 64, 0))::INT AS i0, round_even(window_end / 1000 * 64, 0)::INT AS i1, x,
         round_even((last_word - window_start) / 1000 * 64, 0)::INT AS word_at
  FROM (SELECT t.*, (SELECT max(e) FROM opened o WHERE o.rec = t.rec AND o.turn = t.turn) AS last_word FROM turns t) t JOIN sound s ON s.rec = t.rec),
clips AS (SELECT id, list_transform(range(i0, i1), lambda i: coalesce(x[i + 1]::FLOAT, 0::FLOAT)::DOUBLE) AS x FROM cut),
{VAD},
trimmed AS (
  SELECT c.*, k.x AS clip, greatest(least(len(k.x), speech + 10), least(len(k.x), word_at)) AS n FROM cut c JOIN clips k ON c.id = k.id JOIN speech s ON s.id = c.id),
loud AS (
  SELECT *, sqrt(list_sum(list_transform(clip[1:n], lambda v: v * v)) / n) AS a, sqrt(list_sum(list_transform(clip[greatest(1, n - 2):n], lambda v: v * v)) / least(3, n)) AS b FROM trimmed WHERE n > 0),
quiet AS (SELECT *, n / 64 AS duration FROM loud WHERE NOT (a > 1e-3 AND b > greatest(0.04, 0.4 * a))),
spans AS (
  SELECT q.id, q.duration, o.e AS s, o.next_start AS e, q.window_start FROM opened o JOIN quiet q ON o.rec = q.rec AND o.turn = q.turn WHERE o.hold
  UNION ALL SELECT id, duration, last_end, window_end, window_start FROM quiet),
moved AS (SELECT id, duration, round((s - window_start) / 1000, 3) AS s, round(least((e - window_start) / 1000, duration), 3) AS e FROM spans),
kept AS (SELECT id, count(*) AS n_spans, max(s) AS eot_start, round(max(duration), 3) AS eot_end FROM moved WHERE e > s GROUP BY id)
SELECT 'en__' || q.rec || '__turn_' || lpad(turn_index::VARCHAR, 3, '0') AS id, q.n::BIGINT AS n_samples, round(duration, 6) AS duration, n_spans, eot_start, eot_end,
       round((q.start - window_start) / 1000, 3) AS first_word, trim(transcript) AS content
FROM quiet q JOIN kept k ON q.id = k.id WHERE eot_end - eot_start >= 0.08""",
    "synthetic_signal": "SELECT doc_id, floor(n_chars / 100 * 16)::BIGINT AS n, true AS bounded FROM documents",
    "wav_round_trip": "SELECT vec_id AS id, 64::BIGINT AS rate, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda v: trunc(greatest(-1::FLOAT, least(1::FLOAT, v)) * 32767::FLOAT)::BIGINT)) AS code FROM embeddings",
    "int16_range": f"""WITH {V.X}, y AS (SELECT id, list_transform(x, lambda v: v * CASE WHEN id % 2 = 1 THEN 20000 ELSE 1 END) AS y FROM x)
SELECT id, round(list_sum(list_transform(y, lambda v: abs(v) / CASE WHEN list_max(list_transform(y, lambda u: abs(u))) > 4 THEN 32768 ELSE 1 END)), 6) AS total FROM y""",
}
