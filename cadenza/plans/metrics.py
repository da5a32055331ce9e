"""Evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import scores as S
from cadenza.operators import metrics as M
from cadenza.sources import adapters as A


def predictions(spark, sf_dir):
    return A.predictions(A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels"))


def metrics_by_language(spark, sf_dir):
    r = M.report(predictions(spark, sf_dir))
    return r.select("grp", "n", *(F.round(c, 9).alias(c) for c in ("accuracy", "f1", "auc")))


def auc_rank(spark, sf_dir):
    return M.auc(predictions(spark, sf_dir), ["language"]).select("language", F.round("auc", 9).alias("auc"))


def f1_guarded(spark, sf_dir):
    """F1 per thousand characters of length: many groups have no positive."""
    p = predictions(spark, sf_dir).withColumn("k", F.floor("duration").cast("long"))
    return p.groupBy("k").agg(F.round(M.f1(), 9).alias("f1"), F.count("*").alias("n"))


def duration_buckets(spark, sf_dir):
    b = M.bucket_bias(predictions(spark, sf_dir))
    return b.select("bucket", "n_hold", F.round("false_cutoff", 9).alias("false_cutoff"), "n_eot", F.round("recall", 9).alias("recall"))


def duration_corr(spark, sf_dir):
    return M.hold_correlation(predictions(spark, sf_dir)).select("n", F.round("corr", 6).alias("corr"))


def weighted_bce(spark, sf_dir):
    """Loss with the inverse of the length as weight."""
    z, w = F.col("p_eot") * 4 - 2, 1 / (1 + F.col("duration"))
    return predictions(spark, sf_dir).groupBy("language").agg(F.round(F.avg(w * S.bce(z, F.col("label"))), 6).alias("loss"), F.round(F.avg(S.sigmoid(z)), 6).alias("mean_p"), F.round(F.avg(S.two_way_softmax(z, -z)), 6).alias("mean_softmax"))


def latency_summary(spark, sf_dir):
    out = M.latency(A.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms")), ["event_type"])
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean_ms", "median_ms", "p95_ms", "min_ms", "max_ms", "std_ms")))


def policy_sweep(spark, sf_dir):
    grid = spark.range(5).select(((F.col("id") + 1) / 6).alias("threshold")).crossJoin(spark.range(3).select((F.col("id") * 0.4).alias("action_delay"))).crossJoin(spark.range(2).select((F.col("id") * 3.0 + 2).alias("timeout")))
    p = predictions(spark, sf_dir).withColumn("silence", F.col("duration"))
    out = M.sweep(p, grid, S.decide)
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("action_delay", 6).alias("action_delay"), "timeout", F.round("false_cutoff", 9).alias("false_cutoff"), F.round("recall", 9).alias("recall"))


QUERIES = {f.__name__: f for f in (metrics_by_language, auc_rank, f1_guarded, duration_buckets, duration_corr, weighted_bce, latency_summary, policy_sweep)}
P = "p AS (SELECT d.doc_id AS id, d.lang AS language, l.quality::DOUBLE AS label, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS p, d.n_chars / 1000.0::DOUBLE AS duration FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
F1 = "coalesce(2.0::DOUBLE * count(CASE WHEN p >= 0.5 AND label = 1 THEN 1 END) / nullif(2.0::DOUBLE * count(CASE WHEN p >= 0.5 AND label = 1 THEN 1 END) + count(CASE WHEN (p >= 0.5) <> (label = 1) THEN 1 END), 0), 0)"
AUC = """CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(label * r) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) END"""
SQL = {
    "metrics_by_language": f"""WITH {P}, two AS (SELECT language AS grp, label, p FROM p UNION ALL SELECT 'overall', label, p FROM p),
ranked AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2 AS r FROM two)
SELECT grp, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, round({F1}, 9) AS f1, round({AUC}, 9) AS auc FROM ranked GROUP BY grp""",
    "auc_rank": f"""WITH {P}, ranked AS (SELECT *, rank() OVER (PARTITION BY language ORDER BY p) + (count(*) OVER (PARTITION BY language, p) - 1) / 2 AS r FROM p)
SELECT language, round({AUC}, 9) AS auc FROM ranked GROUP BY language""",
    "f1_guarded": f"WITH {P} SELECT floor(duration)::BIGINT AS k, round({F1}, 9) AS f1, count(*) AS n FROM p GROUP BY 1",
    "duration_buckets": f"""WITH {P}, b AS (SELECT *, CASE WHEN duration >= 0 AND duration < 0.5 THEN '[0, 0.5)' WHEN duration >= 0.5 AND duration < 1 THEN '[0.5, 1)' WHEN duration >= 1 AND duration < 1.5 THEN '[1, 1.5)'
  WHEN duration >= 1.5 AND duration < 2 THEN '[1.5, 2)' WHEN duration >= 2 AND duration < 3 THEN '[2, 3)' ELSE '>= 3' END AS bucket, CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0 END AS hit FROM p)
SELECT bucket, count(CASE WHEN label = 0 THEN 1 END) AS n_hold, round(avg(hit) FILTER (WHERE label = 0), 9) AS false_cutoff, count(CASE WHEN label = 1 THEN 1 END) AS n_eot, round(avg(hit) FILTER (WHERE label = 1), 9) AS recall FROM b GROUP BY bucket""",
    "duration_corr": f"WITH {P} SELECT count(*) AS n, CASE WHEN count(*) > 1 THEN round(corr(duration, p), 6) END AS corr FROM p WHERE label = 0",
    "weighted_bce": f"""WITH {P}, z AS (SELECT *, p * 4 - 2 AS z FROM p)
SELECT language, round(avg(1 / (1 + duration) * (ln(1 + exp(-abs(z))) + greatest(z, 0) - z * label)), 6) AS loss, round(avg(1 / (1 + exp(-z))), 6) AS mean_p, round(avg(1 / (1 + exp(-2 * z))), 6) AS mean_softmax FROM z GROUP BY language""",
    "latency_summary": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
  round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms, round(stddev_pop(value), 6) AS std_ms FROM events GROUP BY event_type""",
    "policy_sweep": f"""WITH {P}, g AS (SELECT (a + 1) / 6 AS threshold, b * 0.4::DOUBLE AS action_delay, c * 3.0::DOUBLE + 2 AS timeout FROM range(5) x(a), range(3) y(b), range(2) z(c)),
d AS (SELECT g.*, label, CASE WHEN duration > 0 AND (duration >= timeout OR (duration >= action_delay AND p >= threshold)) THEN 1.0::DOUBLE ELSE 0 END AS done FROM p, g)
SELECT round(threshold, 6) AS threshold, round(action_delay, 6) AS action_delay, timeout, round(avg(done) FILTER (WHERE label = 0), 9) AS false_cutoff, round(avg(done) FILTER (WHERE label = 1), 9) AS recall
FROM d GROUP BY threshold, action_delay, timeout""",
}
