"""Joins in time over flat tables of words and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import asof as J
from cadenza.operators import turns as O
from cadenza.plans import examples as X
from cadenza.plans import turns as P
from cadenza.sources import adapters as A

LAG, WINDOW = 500, 2000  # milliseconds


TURN = ["rec", "turn_index"]


def flat_tables(spark, sf_dir):
    """Spans (span_index, start) and words (word, end) of the texts' turns, in milliseconds, as tables of their own; numbers name a turn until rows leave a query."""
    words = O.spoken(P.words_of(spark, sf_dir, "documents"), P.SENTENCE, A.TEXT_ORDER).select(*TURN, "word", "end")
    return X.spans(spark, sf_dir).select(*TURN, F.col("span_index").cast("long").alias("span_index"), "start"), words


def asof_range_join(spark, sf_dir):
    """How many words of the turn have ended half a second before each span, and the last of them."""
    spans, words = flat_tables(spark, sf_dir)
    out = J.prior(spans.select(*TURN, "span_index", (F.col("start") - LAG).alias("seen")), words, TURN, "seen", "end", ["word"], None)
    return out.select(X.turn_id(), "span_index", F.col("n_before").alias("n_words"), F.col("last.word").alias("last_word"))


def interval_join(spark, sf_dir):
    """The words that end within two seconds up to each span."""
    spans, words = flat_tables(spark, sf_dir)
    out = J.recent(spans.select(*TURN, "span_index", "start"), words, TURN, "start", "end", WINDOW)
    return out.select(X.turn_id(), "span_index", F.col("n").alias("n_words"), F.col("first").alias("first_end"), F.col("last").alias("last_end"))


def asof_events(spark, sf_dir):
    """For each event of a user, how many purchases came before it or with it, and when the last began: days are bins, so that a busy user is many tasks."""
    events = A.event_words(A.table(spark, sf_dir, "events")).select("rec", "pos", "word", "start")
    bought = events.where("word = 'purchase'").select("rec", F.col("start").alias("at"))
    out = J.prior(events, bought, ["rec"], "start", "at", ["at"], 86_400_000_000)
    return out.select("rec", "pos", "n_before", F.col("last.at").alias("last_at"))


QUERIES = {f.__name__: f for f in (asof_range_join, interval_join, asof_events)}
SQL = {
    "asof_range_join": f"""WITH {X.ROWS}
SELECT s.id, s.span_index, count(CASE WHEN o.e <= s.s * 1000 - {LAG} THEN 1 END) AS n_words, max_by(o.word, (o.e, o.word)) FILTER (WHERE o.e <= s.s * 1000 - {LAG}) AS last_word
FROM spans s JOIN ids i ON s.id = i.id JOIN opened o ON o.rec = i.rec AND o.turn = i.turn GROUP BY s.id, s.span_index""",
    "interval_join": f"""WITH {X.ROWS}
SELECT s.id, s.span_index, count(*) AS n_words, min(o.e) AS first_end, max(o.e) AS last_end
FROM spans s JOIN ids i ON s.id = i.id JOIN opened o ON o.rec = i.rec AND o.turn = i.turn
WHERE o.e BETWEEN round(s.s * 1000) - {WINDOW} AND round(s.s * 1000) GROUP BY s.id, s.span_index""",
    "asof_events": f"""WITH {P.EVENT_SQL},
bought AS (SELECT rec AS r, s AS began FROM words WHERE word = 'purchase')
SELECT rec, pos, count(began) AS n_before, max(began) AS last_at FROM words LEFT JOIN bought ON r = rec AND began <= s GROUP BY rec, pos, s""",
}
