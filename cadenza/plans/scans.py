"""Alignment scans over the given tables: words in the rows, and timestamped texts with audio elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.sources import adapters as A
from cadenza.sources import alignments as L


def words_of(text):
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def embedded_scan(spark, sf_dir):
    """Documents as rows of words with times as strings; every fifth word has none and is dropped, as are rows without words."""
    item = lambda w, p: F.struct(w.alias("word"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("token"), F.when(p % 5 != 4, p.cast("string")).alias("start"), (p + 1).cast("string").alias("end"))
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.transform(words_of(F.col("text")), item).alias("words"))
    out = L.embedded(rows, "en", "doc_id")
    return out.select("source_id", F.size("words").cast("long").alias("n_words"), F.element_at("words", -1)["end"].alias("last_end"), F.element_at("words", 1)["word"].alias("first_word"))


def external_rows(spark, sf_dir):
    """Conversations as parallel lists of timestamped texts and of file names, one name short; and the members of archives, some missing."""
    stamp = lambda p, part: F.concat(F.lit("<|"), p.cast("string"), F.lit(f".{part}|>"))
    told = F.array_join(F.transform(words_of(F.coalesce("text", F.lit(""))), lambda w, p: F.concat(stamp(p + 1, 5), F.lit(" "), T.escaped(w), stamp(p + 1, 9))), "")
    turns = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", told.alias("t"), F.concat_ws("-", "conv_id", "turn").alias("file"))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t", "file"))).alias("x"))
    number = F.col("conv_id")
    rows = lists.select(
        "conv_id", F.when(number % 2 == 0, "whole").otherwise("streaming").alias("mode"), F.when(number % 3 == 0, "segment").otherwise("word").alias("level"),
        F.transform("x", lambda v: v["t"]).alias("texts"), F.transform(F.slice("x", F.lit(1), F.size("x") - 1), lambda v: v["file"]).alias("audio_filenames"),
    )
    return rows, turns.where("turn % 3 <> 2").select(F.col("file").alias("member"), F.lit(b"").alias("content"))


def external_scan(spark, sf_dir):
    """Recordings of both modes: one for each segment with words and audio; in streaming mode times count from the first word."""
    rows, members = external_rows(spark, sf_dir)
    out = None
    for mode in ("whole", "streaming"):
        own = L.external(rows, members, mode, "conv_id").select(F.lit(mode).alias("mode"), "source_id", "member", F.size("words").cast("long").alias("n_words"), *(F.round(F.element_at("words", k)[c], 3).alias(n) for k, c, n in ((1, "start", "first_start"), (-1, "end", "last_end"))))
        out = own if out is None else out.unionByName(own)
    return out


QUERIES = {f.__name__: f for f in (embedded_scan, external_scan)}
SPLIT = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
SQL = {
    "embedded_scan": f"""WITH d AS (SELECT doc_id, {SPLIT} AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM d)
SELECT 'en_' || doc_id AS source_id, count(*) AS n_words, (max(p) + 1)::DOUBLE AS last_end, arg_min(word, p) AS first_word FROM w WHERE p % 5 <> 4 GROUP BY doc_id""",
    "external_scan": f"""WITH c AS (
  SELECT conv_id, turn, len({SPLIT}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT CASE WHEN conv_id % 2 = 0 THEN 'whole' ELSE 'streaming' END AS mode, conv_id || '_' || i AS source_id, conv_id || '-' || turn AS member, n AS n_words,
       CASE WHEN conv_id % 2 = 0 THEN 1.5::DOUBLE ELSE 0.0 END AS first_start, CASE WHEN conv_id % 2 = 0 THEN n + 0.9::DOUBLE ELSE round(n - 0.6::DOUBLE, 3) END AS last_end
FROM c WHERE conv_id % 3 <> 0 AND i < total - 1 AND turn % 3 <> 2 AND n > 0""",
}
