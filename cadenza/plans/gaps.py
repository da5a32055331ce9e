"""Gap distributions, thresholds, and span profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import gaps as G
from cadenza.operators import metrics as M
from cadenza.operators import turns as O
from cadenza.plans import turns as P
from cadenza.sources import adapters as A

FLOOR_EVENTS, FLOOR_WORDS = 360.0, 0.05
SECONDS_EVENTS = f"{P.EVENT_SQL}, {P.GAPS_SQL}, gaps AS (SELECT greatest(gap, 0) / 1000000 AS gap FROM near WHERE gap IS NOT NULL)"
SECONDS_WORDS = f"{P.TEXT_SQL}, {P.GAPS_SQL}, gaps AS (SELECT greatest(gap, 0) / 1000 AS gap FROM near WHERE gap IS NOT NULL)"


def seconds(spark, sf_dir, source="events"):
    if source == "events":
        return O.gaps(A.event_words(A.table(spark, sf_dir, "events"))).select((F.col("gap") / 1_000_000).alias("gap"))
    return O.gaps(A.text_words(A.table(spark, sf_dir, "documents"))).select((F.col("gap") / 1000).alias("gap"))


def gap_percentiles(spark, sf_dir):
    row = G.percentiles(seconds(spark, sf_dir), FLOOR_EVENTS)
    return row.select("n_gaps", *(F.round(f"p{p}", 6).alias(f"p{p}") for p in G.PERCENTILES))


def gap_log_histogram(spark, sf_dir):
    rows = G.log_histogram(seconds(spark, sf_dir), FLOOR_EVENTS)
    most = rows.agg(F.max("n").alias("most"))
    return rows.join(F.broadcast(most)).select("bin", "n", G.bar(F.col("n"), F.col("most")).alias("bar"))


def gap_kde_grid(spark, sf_dir):
    return G.density(seconds(spark, sf_dir, "documents"), FLOOR_WORDS).select("i", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


def gap_kde_valley(spark, sf_dir):
    return G.valley(seconds(spark, sf_dir, "documents"), FLOOR_WORDS)


def gap_kde_fallback(spark, sf_dir):
    """One mode only: the 75th percentile is recommended."""
    return G.valley(seconds(spark, sf_dir), FLOOR_EVENTS).select("n_gaps", "mode_low", "recommended")


def labelled_spans(spark, sf_dir):
    spans = P.built(spark, sf_dir, P.SEGMENT, "events").select("rec", F.posexplode("spans").alias("i", "s"), F.col("n_holds").alias("h"))
    return spans.select("rec", F.when(F.col("i") == F.col("h"), "eot").otherwise("hold").alias("label"), ((F.col("s.end") - F.col("s.start")) / 1_000_000).alias("seconds"))


def span_label_profile(spark, sf_dir):
    out = M.summary(labelled_spans(spark, sf_dir), ["label"], "seconds", {"median": 0.5, "p10": 0.1, "p90": 0.9}, {"n": F.count("*"), "mean": F.avg("seconds"), "max": F.max("seconds")})
    return out.select("label", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p10", "p90")), "max")


def span_share_by_set(spark, sf_dir):
    """Shares of holds and ends in two sets of turns, side by side."""
    one = P.built(spark, sf_dir, P.SEGMENT, "events").select(F.lit("segment").alias("name"), "n_holds")
    two = P.built(spark, sf_dir, P.VARIANTS["turn_single"][0], "events").select(F.lit("single").alias("name"), "n_holds")
    both = one.unionByName(two).groupBy("name").agg(F.count("*").alias("n_eot"), F.sum("n_holds").alias("n_hold"))
    return both.withColumn("eot_share", F.round(F.col("n_eot") / (F.col("n_eot") + F.col("n_hold")), 9))


def nspans_distribution(spark, sf_dir):
    return P.built(spark, sf_dir, P.SEGMENT, "events").groupBy((F.col("n_holds") + 1).cast("long").alias("n_spans")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (gap_percentiles, gap_log_histogram, gap_kde_grid, gap_kde_valley, gap_kde_fallback, span_label_profile, span_share_by_set, nspans_distribution)}


def kde_sql(gaps: str, floor: float) -> str:
    return f"""{gaps},
kept AS (SELECT log10(gap) AS g FROM gaps WHERE gap >= {floor} AND gap > 0),
bounds AS (SELECT min(g) AS lo, max(g) AS hi, count(*) AS n FROM kept),
grid AS (SELECT i, lo + (hi - lo) * i / 199 AS x, n FROM bounds, range(200) r(i) WHERE n >= 20 AND hi > lo),
few AS (SELECT g, count(*) AS c FROM kept GROUP BY g),
curve AS (
  SELECT i, x, round(sum(c * exp(-0.5 * ((g - x) / 0.12) * ((g - x) / 0.12))) / (max(n) * 0.12 * sqrt(2 * pi())), 9) AS density
  FROM grid, few GROUP BY i, x),
sides AS (SELECT *, lag(density) OVER (ORDER BY i) AS a, lead(density) OVER (ORDER BY i) AS b FROM curve),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY density DESC, i) AS k FROM sides WHERE density > a AND density >= b) WHERE k <= 2),
modes AS (SELECT min(i) AS a, max(i) AS b, min(x) AS x1, max(x) AS x2, count(*) AS n FROM tops),
lowest AS (
  SELECT arg_min(s.x, s.density * 1000000 + s.i / 1000000.0) AS v FROM sides s, modes m
  WHERE s.density < s.a AND s.density <= s.b AND m.n = 2 AND s.i > m.a AND s.i < m.b),
found AS (
  SELECT (SELECT count(*) FROM gaps WHERE gap >= {floor}) AS n_gaps, (SELECT quantile_cont(gap, 0.75) FROM gaps WHERE gap >= {floor}) AS p75,
         CASE WHEN n > 0 THEN round(pow(10, x1), 6) END AS mode_low, CASE WHEN n > 1 THEN round(pow(10, x2), 6) END AS mode_high, pow(10, v) AS v
  FROM modes, lowest)"""


HIST = f"""WITH {SECONDS_EVENTS},
kept AS (SELECT log10(gap) AS g FROM gaps WHERE gap >= {FLOOR_EVENTS} AND gap > 0),
bounds AS (SELECT min(g) AS lo, CASE WHEN max(g) > min(g) THEN max(g) ELSE min(g) + 1 END AS hi FROM kept),
counted AS (SELECT least(floor((g - lo) / (hi - lo) * 30), 29)::BIGINT AS bin, count(*) AS n FROM kept, bounds GROUP BY 1),
filled AS (SELECT r.bin, coalesce(n, 0)::BIGINT AS n FROM range(30) r(bin) LEFT JOIN counted c ON r.bin = c.bin)
SELECT bin, n, repeat('#', round_even(n / (SELECT max(n) FROM filled) * 50, 0)::INT) AS bar FROM filled"""
LABELLED = f"""{P.SEGMENT_SQL},
spans AS (
  SELECT 'hold' AS label, (next_start - e) / 1000000 AS seconds FROM opened WHERE hold
  UNION ALL SELECT 'eot', (window_end - last_end) / 1000000 FROM turns)"""
QUANTILES = ", ".join(f"round(quantile_cont(gap, {p / 100}), 6) AS p{p}" for p in G.PERCENTILES)
SINGLE_SQL = P.turn_ctes(P.EVENT_SQL, P.VARIANTS["turn_single"][0])
SQL = {
    "gap_percentiles": f"WITH {SECONDS_EVENTS} SELECT count(*) AS n_gaps, {QUANTILES} FROM gaps WHERE gap >= {FLOOR_EVENTS}",
    "gap_log_histogram": HIST,
    "gap_kde_grid": f"WITH {kde_sql(SECONDS_WORDS, FLOOR_WORDS)} SELECT i, round(x, 6) AS x, round(density, 6) AS density FROM curve",
    "gap_kde_valley": f"WITH {kde_sql(SECONDS_WORDS, FLOOR_WORDS)} SELECT n_gaps, mode_low, mode_high, round(v, 6) AS valley, coalesce(round(v, 3), round(p75, 6), {5 * FLOOR_WORDS}) AS recommended FROM found",
    "gap_kde_fallback": f"WITH {kde_sql(SECONDS_EVENTS, FLOOR_EVENTS)} SELECT n_gaps, mode_low, coalesce(round(v, 3), round(p75, 6), {5 * FLOOR_EVENTS}) AS recommended FROM found",
    "span_label_profile": f"""WITH {LABELLED} SELECT label, count(*) AS n, round(avg(seconds), 6) AS mean, round(quantile_cont(seconds, 0.5), 6) AS median,
  round(quantile_cont(seconds, 0.1), 6) AS p10, round(quantile_cont(seconds, 0.9), 6) AS p90, max(seconds) AS max FROM spans GROUP BY label""",
    "span_share_by_set": f"""SELECT name, n_eot, n_hold, round(n_eot / (n_eot + n_hold), 9) AS eot_share FROM (
  SELECT 'segment' AS name, count(*) AS n_eot, sum(n_holds)::BIGINT AS n_hold FROM (WITH {P.SEGMENT_SQL} SELECT n_holds FROM turns)
  UNION ALL SELECT 'single', count(*), sum(n_holds)::BIGINT FROM (WITH {SINGLE_SQL} SELECT n_holds FROM turns))""",
    "nspans_distribution": f"WITH {P.SEGMENT_SQL} SELECT n_holds + 1 AS n_spans, count(*) AS n FROM turns GROUP BY 1",
}
