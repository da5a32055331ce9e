"""Decision points, markers, grids, and token sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import examples as E
from cadenza.operators import turns as O
from cadenza.plans import turns as P
from cadenza.sources import adapters as A

SPECIAL = {"start": 1000, "end": 1001, "audio_bos": 1002, "audio": 1003, "audio_eos": 1004, "eot": 1005, "hold": 1006}
RATE = 16000


def fixed_ids(*parts: str) -> str:
    """A list in SQL: special tokens by name, other parts as codes of their characters."""
    return "[" + ", ".join(str(i) for p in parts for i in ([SPECIAL[p]] if p in SPECIAL else map(ord, p))) + "]"


def codes_sql(text: str) -> str:
    return f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: unicode(c))"


def rows(spark, sf_dir):
    """Turns of the texts in seconds, as far as they are rows: id, spans, words, duration."""
    built = P.built(spark, sf_dir, P.SENTENCE, "documents")
    sec = lambda s: F.struct((s["start"] / 1000).alias("start"), (s["end"] / 1000).alias("end"))
    word = lambda w: F.struct(w["word"].alias("word"), (w["start"] / 1000).alias("start"), (w["end"] / 1000).alias("end"))
    return built.select(F.concat_ws(":", "rec", "turn_index").alias("id"), F.transform("spans", sec).alias("spans"), F.transform("words", word).alias("words"), (F.col("window_end") / 1000).alias("duration"))


ROWS = f"""{P.SENTENCE_SQL},
ids AS (SELECT *, rec || ':' || turn_index AS id FROM turns),
spans AS (
  SELECT i.id, i.n_holds + 1 AS n_spans, row_number() OVER (PARTITION BY o.rec, o.turn ORDER BY o.k) - 1 AS span_index, o.e / 1000 AS s, o.next_start / 1000 AS e
  FROM opened o JOIN ids i ON o.rec = i.rec AND o.turn = i.turn WHERE o.hold
  UNION ALL SELECT id, n_holds + 1, n_holds, last_end / 1000, window_end / 1000 FROM ids),
raw AS (
  SELECT s.*, f.k, trunc(least(s.s + f.o, s.e) * {RATE})::BIGINT AS cut FROM spans s, (VALUES (0, 0.0::DOUBLE), (1, 0.2::DOUBLE), (2, 0.6::DOUBLE), (3, 1.2::DOUBLE)) f(k, o)),
once AS (SELECT id, n_spans, span_index, cut, min(k) AS k FROM raw WHERE cut > 0 GROUP BY id, n_spans, span_index, cut),
points AS (
  SELECT id, span_index, CASE WHEN span_index = n_spans - 1 THEN 1.0::DOUBLE ELSE 0.0 END AS label, row_number() OVER (PARTITION BY id, span_index ORDER BY k) - 1 AS cut_index,
         cut AS cut_sample, 1.0::DOUBLE / n_spans / count(*) OVER (PARTITION BY id, span_index) AS weight, n_spans FROM once)"""


def turn_id():
    """A turn's name, for rows that leave a query; until then the recording's key keeps the shuffle of the texts in use."""
    return F.concat_ws(":", "rec", "turn_index").alias("id")


def spans(spark, sf_dir):
    """Spans of the texts' turns as rows, in milliseconds."""
    return O.spans(P.words_of(spark, sf_dir, "documents"), P.SENTENCE, A.TEXT_ORDER)


def points(spark, sf_dir):
    """Causal examples of the texts' turns."""
    return E.causal_points(spans(spark, sf_dir).withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000), F.lit(RATE))


def causal_expand(spark, sf_dir):
    out = points(spark, sf_dir)
    return out.select(turn_id(), F.col("span_index").cast("long").alias("span_index"), "label", F.col("cut_index").cast("long").alias("cut_index"), "cut_sample", F.round("weight", 9).alias("weight"))


def causal_weights(spark, sf_dir):
    """A turn's weight is 1 when every span has a cut."""
    out = points(spark, sf_dir).groupBy("rec", "turn_index").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"))
    return out.select(turn_id(), "weight", "n")


def singleton_sample(spark, sf_dir):
    return E.causal(rows(spark, sf_dir).select("id", "spans"), F.lit(RATE), keep_single=0.3).select("id", F.col("n_spans").cast("long").alias("n_spans")).distinct()


def marker_expand(spark, sf_dir):
    out = E.marker_rows(O.spoken(P.words_of(spark, sf_dir, "documents"), P.SENTENCE, A.TEXT_ORDER), A.TEXT_ORDER)
    return out.select(turn_id(), F.col("k").cast("long").alias("k"), F.round(F.col("end_time") / 1000, 3).alias("end_sec"), "marker", "transcript")


def asof_prior_words(spark, sf_dir):
    """Words that have ended half a second before each span."""
    words = O.spoken(P.words_of(spark, sf_dir, "documents"), P.SENTENCE, A.TEXT_ORDER)
    own = Window.partitionBy("rec", "turn_index")
    index = F.count("silence").over(own.orderBy(*O.ORDER).rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = words.withColumn("span_index", index).withColumn("n_words", F.count("*").over(own.orderBy("end").rangeBetween(Window.unboundedPreceding, -500)))
    return rows.where("silence IS NOT NULL").select(turn_id(), "span_index", "n_words")


def query_time_grid(spark, sf_dir):
    return E.span_times(spans(spark, sf_dir), 100, 100).select(turn_id(), "time")


def lengths(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("lang", "doc_id", F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")).alias("n"))


def cu_seqlens(spark, sf_dir):
    out = E.offsets(lengths(spark, sf_dir), "lang", "doc_id", "n")
    return out.select("lang", "i", "start")


def conversations(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").withColumn("ids", T.char_codes(F.col("text")))


def pad_and_mask(spark, sf_dir):
    """Turns of each conversation padded to its longest."""
    c = conversations(spark, sf_dir)
    longest = c.groupBy("conv_id").agg(F.max(F.size("ids")).alias("m"))
    out = c.join(longest, "conv_id").select("conv_id", "turn", E.padded(F.col("ids"), F.col("m"), 7).alias("p"), E.mask(F.col("ids"), F.col("m")).alias("mask"))
    return out.select("conv_id", "turn", F.size("p").cast("long").alias("size"), F.array_join("p", ",").alias("ids"), F.array_join("mask", ",").alias("mask"))


def audio_token_count(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.audio_tokens(F.col("n_chars") - 500).alias("tokens"))


def prompt_labels(spark, sf_dir):
    marker = F.when(F.col("role") == "user", SPECIAL["eot"]).otherwise(SPECIAL["hold"])
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", E.chat_example(T.char_codes, SPECIAL, marker, (F.col("turn") % 8).cast("int"), F.col("text"), "be brief").alias("x"))
    return c.select("conv_id", "turn", *(F.array_join(f"x.{k}", ",").alias(k) for k in ("input_ids", "labels", "position_ids")))


def probe_prompt(spark, sf_dir):
    """As many audio tokens as the turn's text has characters, up to 7."""
    p = E.probe_prompt(T.char_codes, SPECIAL, F.coalesce(F.length("text"), F.lit(0)) % 8, "Done? yes or no.")
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(p, ",").alias("ids"))


def varlen_packing(spark, sf_dir):
    c = conversations(spark, sf_dir).select("conv_id", "turn", F.col("ids").alias("input_ids"), F.transform("ids", lambda v, i: F.when(i < 2, F.lit(E.IGNORE)).otherwise(v)).alias("labels"))
    p = E.packed(c, F.col("conv_id"), F.col("turn"))
    whole = lambda c: F.array_join(c, ",").alias(c)
    return p.select(F.col("batch").alias("conv_id"), whole("input_ids"), whole("labels"), whole("cu_seqlens"), F.col("max_len").cast("long").alias("max_len"))


QUERIES = {f.__name__: f for f in (causal_expand, causal_weights, singleton_sample, marker_expand, asof_prior_words, query_time_grid, cu_seqlens, pad_and_mask, audio_token_count, prompt_labels, probe_prompt, varlen_packing)}
UNIT = "('0x' || substr(sha256(id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"
LENGTHS = "t AS (SELECT lang, doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS n FROM documents)"
SQL = {
    "causal_expand": f"WITH {ROWS} SELECT id, span_index, label, cut_index, cut_sample, round(weight, 9) AS weight FROM points",
    "causal_weights": f"WITH {ROWS} SELECT id, round(sum(weight), 6) AS weight, count(*) AS n FROM points GROUP BY id",
    "singleton_sample": f"WITH {ROWS} SELECT DISTINCT id, n_spans FROM points WHERE n_spans > 1 OR {UNIT} < 0.3",
    "marker_expand": f"""WITH {ROWS}
SELECT s.id, s.span_index AS k, round(CASE WHEN s.span_index = s.n_spans - 1 THEN i.window_end / 1000 ELSE s.e END, 3) AS end_sec,
       CASE WHEN s.span_index = s.n_spans - 1 THEN 'eot' ELSE 'hold' END AS marker,
       string_agg(o.word, ' ' ORDER BY o.k) FILTER (WHERE s.span_index = s.n_spans - 1 OR o.e / 1000 <= s.s + 1e-6) AS transcript
FROM spans s JOIN ids i ON s.id = i.id JOIN opened o ON o.rec = i.rec AND o.turn = i.turn
GROUP BY s.id, s.span_index, s.n_spans, s.e, i.window_end""",
    "asof_prior_words": f"""WITH {ROWS}
SELECT s.id, s.span_index, count(CASE WHEN o.e / 1000 <= s.s - 0.5::DOUBLE + 1e-6 THEN 1 END) AS n_words
FROM spans s JOIN ids i ON s.id = i.id JOIN opened o ON o.rec = i.rec AND o.turn = i.turn GROUP BY s.id, s.span_index""",
    "query_time_grid": f"""WITH {P.SENTENCE_SQL},
spans AS (
  SELECT t.rec || ':' || t.turn_index AS id, o.e AS s, o.next_start AS e FROM opened o JOIN turns t ON o.rec = t.rec AND o.turn = t.turn WHERE o.hold
  UNION ALL SELECT rec || ':' || turn_index, last_end, window_end FROM turns)
SELECT DISTINCT id, unnest(range(s, e + 1, 100)) AS time FROM spans WHERE e - s >= 100""",
    "cu_seqlens": f"""WITH {LENGTHS}, p AS (SELECT lang, row_number() OVER w AS i, sum(n) OVER w AS start FROM t WINDOW w AS (PARTITION BY lang ORDER BY doc_id))
SELECT lang, i, start::BIGINT AS start FROM p UNION ALL SELECT DISTINCT lang, 0, 0 FROM t""",
    "pad_and_mask": f"""WITH c AS (SELECT conv_id, turn, {codes_sql('text')} AS p FROM conversations),
d AS (SELECT *, max(len(p)) OVER (PARTITION BY conv_id) AS m FROM c)
SELECT conv_id, turn, m AS size, array_to_string(list_concat(p, list_transform(range(m - len(p)), lambda i: 7)), ',') AS ids,
       array_to_string(list_concat(list_transform(p, lambda i: 1), list_transform(range(m - len(p)), lambda i: 0)), ',') AS mask FROM d""",
    "audio_token_count": "SELECT doc_id, CASE WHEN n_chars - 500 <= 0 THEN 0 ELSE (n_chars - 501) // 2 + 1 END AS tokens FROM documents",
    "prompt_labels": f"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1005 ELSE 1006 END AS marker, CASE WHEN length(text) > 0 THEN {codes_sql("' ' || text")} ELSE [] END AS said FROM conversations),
p AS (
  SELECT conv_id, turn, list_concat({fixed_ids('start', 'system\n', 'be brief', 'end', '\n', 'start', 'user\n', 'audio_bos')}, list_transform(range(turn % 8), lambda i: 1003),
    {fixed_ids('audio_eos', 'end', '\n', 'start', 'assistant\n')}) AS asked, list_concat([marker], said, {fixed_ids('end')}) AS told FROM t)
SELECT conv_id, turn, array_to_string(list_concat(asked, told, [10]), ',') AS input_ids, array_to_string(list_concat(list_transform(asked, lambda i: -100), told, [-100]), ',') AS labels,
       array_to_string(range(len(asked) + len(told) + 1), ',') AS position_ids FROM p""",
    "probe_prompt": f"""SELECT conv_id, turn, array_to_string(list_concat({fixed_ids('audio_bos')}, list_transform(range(coalesce(length(text), 0) % 8), lambda i: 1003), {fixed_ids('audio_eos', 'Done? yes or no.')}), ',') AS ids FROM conversations""",
    "varlen_packing": f"""WITH c AS (SELECT conv_id, turn, {codes_sql('text')} AS p FROM conversations WHERE length(text) > 0),
d AS (SELECT *, coalesce(sum(len(p)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS total FROM c)
SELECT conv_id, array_to_string(flatten(list(p ORDER BY turn)), ',') AS input_ids, array_to_string(flatten(list(list_concat(list_transform(p[1:2], lambda v: -100), p[3:]) ORDER BY turn)), ',') AS labels,
       array_to_string(list_concat([0], list(total::BIGINT ORDER BY turn)), ',') AS cu_seqlens, max(len(p)) AS max_len
FROM d GROUP BY conv_id""",
}
