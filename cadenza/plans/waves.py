"""Waveform operators over short arrays (64 samples, frames of 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import scores as S
from cadenza.functions import waves as W
from cadenza.operators import metrics as M
from cadenza.operators import rows as R
from cadenza.sources import adapters as A

FRAME, HOP, SECONDS, FLOOR = 4, 2, 0.0625, -20.0


def waves(spark, sf_dir):
    return A.waves(A.table(spark, sf_dir, "embeddings"))


def summed(x):
    return F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 6)


def wave_rms_dbfs(spark, sf_dir):
    return waves(spark, sf_dir).select("id", F.round(W.dbfs(F.col("x")), 6).alias("dbfs"))


def wave_vad_end(spark, sf_dir):
    """End sample of the last frame louder than a tenth of the 95th percentile of frame loudness."""
    return waves(spark, sf_dir).select("id", W.vad_end(F.col("x"), FRAME, HOP).cast("long").alias("end_sample"))


def wave_slice_pad(spark, sf_dir):
    first, last = F.rint(F.col("id") % 40 - 5).cast("int"), (F.rint(F.col("id") % 40 - 5) + 40).cast("int")
    clip = W.cut(F.col("x"), first, last)
    return waves(spark, sf_dir).select("id", F.size(clip).cast("long").alias("n"), summed(clip).alias("total"), F.round(clip[0].cast("double"), 6).alias("first"))


def wave_resample(spark, sf_dir):
    y = W.resampled(F.col("x"), F.rint(F.size("x") * 24 / F.lit(64)).cast("int"))
    return waves(spark, sf_dir).select("id", F.posexplode(y).alias("i", "y")).select("id", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


def wave_mulaw(spark, sf_dir):
    return waves(spark, sf_dir).select("id", F.posexplode(W.mu_law(F.col("x"))).alias("i", "y")).select("id", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


def wave_snr_mix(spark, sf_dir):
    y = W.mixed(F.col("x"), F.reverse("x"), (F.col("id") % 20).cast("double"))
    return waves(spark, sf_dir).select("id", summed(F.transform(y, lambda v: v * v)).alias("energy"))


def wave_recent_window(spark, sf_dir):
    r = W.recent(F.col("x"), (F.col("id") % 80).cast("int") + 1)
    return waves(spark, sf_dir).select("id", F.size(r).cast("long").alias("n"), F.round(r[0].cast("double"), 6).alias("first"))


def wave_peak_normalize(spark, sf_dir):
    return waves(spark, sf_dir).select("id", F.round(F.array_max(F.transform(W.peak_normalized(W.from_int16(F.col("x"))), lambda v: F.abs(v))), 6).alias("peak"))


def trailing_silence(spark, sf_dir):
    return waves(spark, sf_dir).select("id", F.round(W.trailing_silence(F.col("x"), FRAME, SECONDS, FLOOR), 6).alias("silence"))


def sustained_speech(spark, sf_dir):
    best = W.longest_loud_run(F.col("x"), FRAME, FLOOR)
    return waves(spark, sf_dir).select("id", best.cast("long").alias("longest"), (best >= 3).alias("speech"))


def heuristic_score(spark, sf_dir):
    silence = W.trailing_silence(F.col("x"), FRAME, SECONDS, FLOOR)
    return waves(spark, sf_dir).select("id", F.round(S.heuristic(silence), 6).alias("p_eot"))


def policy_decide(spark, sf_dir):
    silence = W.trailing_silence(F.col("x"), FRAME, SECONDS, FLOOR)
    p = F.pmod(F.col("id") * 37, F.lit(100)) / 100
    return waves(spark, sf_dir).select("id", S.decide(p, silence, 0.5, 0.1, 0.9).alias("status"))


def tail_gate(spark, sf_dir):
    """Clips whose last samples are as loud as speech."""
    x = F.col("x")
    return waves(spark, sf_dir).select("id", R.loud_tail(W.rms(x), W.rms(W.recent(x, F.lit(8))), 0.9).alias("loud"))


def tail_rms_summary(spark, sf_dir):
    tails = waves(spark, sf_dir).select("label", W.rms(W.recent(F.col("x"), F.lit(8))).alias("r"))
    out = M.summary(tails, ["label"], "r", {"p90": 0.9}, {"mean": F.avg("r"), "max": F.max("r")})
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("mean", "p90", "max")))


def bottleneck_pick(spark, sf_dir):
    band = 2000.0 + (F.col("id") * 53) % 9000
    return waves(spark, sf_dir).select("id", W.bottleneck(band).cast("long").alias("rate"))


QUERIES = {f.__name__: f for f in (wave_rms_dbfs, wave_vad_end, wave_slice_pad, wave_resample, wave_mulaw, wave_snr_mix, wave_recent_window, wave_peak_normalize, trailing_silence, sustained_speech, heuristic_score, policy_decide, tail_gate, tail_rms_summary, bottleneck_pick)}

X = "x AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
POWER = "list_sum(list_transform({0}, lambda v: v * v)) / len({0})"
DB = "20 * log10(sqrt(" + POWER + ") + 2e-9)"
FRAMES = f"""{X},
frames AS (SELECT id, k, x[k * 4 + 1:k * 4 + 4] AS f FROM (SELECT id, x, unnest(range(16)) AS k FROM x)),
loud AS (SELECT id, k, {DB.format('f')} > {FLOOR} AS loud FROM frames),
quiet AS (SELECT id, (15 - coalesce(max(CASE WHEN loud THEN k END), -1)) * {SECONDS}::DOUBLE AS silence FROM loud GROUP BY id)"""
SQL = {
    "wave_rms_dbfs": f"WITH {X} SELECT id, round({DB.format('x')}, 6) AS dbfs FROM x",
    "wave_vad_end": f"""WITH {X},
f AS (SELECT id, k, x[k * 2 + 1:k * 2 + 4] AS f FROM (SELECT id, x, unnest(range(31)) AS k FROM x)),
r AS (SELECT id, k, sqrt({POWER.format('f')}) AS rms FROM f),
b AS (SELECT id, greatest(1e-3, 0.1 * quantile_cont(rms, 0.95)) AS bound FROM r GROUP BY id)
SELECT r.id, coalesce(max(CASE WHEN rms > bound THEN k * 2 + 4 END), 0)::BIGINT AS end_sample FROM r JOIN b ON r.id = b.id GROUP BY r.id""",
    "wave_slice_pad": f"""WITH {X}, c AS (SELECT id, x[greatest(0, id % 40 - 5) + 1:id % 40 + 35] AS c, id % 40 + 35 - greatest(0, id % 40 - 5) AS n FROM x)
SELECT id, n, round(list_sum(c), 6) AS total, round(c[1], 6) AS first FROM c""",
    "wave_resample": f"""WITH {X}, p AS (SELECT id, x, i, i * 63.0::DOUBLE / 23 AS p FROM (SELECT id, x, unnest(range(24)) AS i FROM x)),
q AS (SELECT id, i, p - floor(p) AS t, x[floor(p)::INT + 1] AS a, x[least(floor(p)::INT + 2, 64)] AS b FROM p)
SELECT id, i, round(a + (b - a) * t, 6) AS y FROM q""",
    "wave_mulaw": f"""WITH {X}, v AS (SELECT id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM x),
c AS (SELECT id, i, greatest(least(v, 1.0), -1.0) AS v FROM v),
q AS (SELECT id, i, round_even((sign(v) * ln(1 + 255 * abs(v)) / ln(256) + 1) / 2 * 255, 0) / 255 * 2 - 1 AS y FROM c)
SELECT id, i, round(sign(y) * (exp(abs(y) * ln(256)) - 1) / 255, 6) AS y FROM q""",
    "wave_snr_mix": f"""WITH {X}, s AS (SELECT id, x, sqrt(({POWER.format('x')} + 1e-12) / (({POWER.format('list_reverse(x)')} + 1e-12) * pow(10.0::DOUBLE, (id % 20) / 10))) AS s FROM x)
SELECT id, round(list_sum(list_transform(list_zip(x, list_reverse(x)), lambda p: (p[1] + s * p[2]) * (p[1] + s * p[2]))), 6) AS energy FROM s""",
    "wave_recent_window": f"WITH {X} SELECT id, least(64, id % 80 + 1) AS n, round(x[greatest(1, 64 - id % 80)], 6) AS first FROM x",
    "wave_peak_normalize": f"WITH {X}, m AS (SELECT id, list_max(list_transform(x, lambda v: abs(v))) AS m FROM x) SELECT id, round(CASE WHEN m > 1e-6 THEN m / m * 0.95::DOUBLE ELSE m END, 6) AS peak FROM m",
    "trailing_silence": f"WITH {FRAMES} SELECT id, round(silence, 6) AS silence FROM quiet",
    "sustained_speech": f"""WITH {FRAMES}, g AS (SELECT id, k - row_number() OVER (PARTITION BY id ORDER BY k) AS g FROM loud WHERE loud),
r AS (SELECT id, count(*) AS n FROM g GROUP BY id, g)
SELECT x.id, coalesce(max(n), 0) AS longest, coalesce(max(n), 0) >= 3 AS speech FROM x LEFT JOIN r ON x.id = r.id GROUP BY x.id""",
    "heuristic_score": f"WITH {FRAMES} SELECT id, round(1 - exp(-silence / 0.6::DOUBLE), 6) AS p_eot FROM quiet",
    "policy_decide": f"""WITH {FRAMES} SELECT id, CASE WHEN silence <= 0 THEN 'listening' WHEN silence >= 0.9 THEN 'end_of_turn (timeout)'
  WHEN silence >= 0.1 AND (id * 37) % 100 / 100 >= 0.5 THEN 'end_of_turn' ELSE 'holding' END AS status FROM quiet""",
    "tail_gate": f"WITH {X}, r AS (SELECT id, sqrt({POWER.format('x')}) AS a, sqrt({POWER.format('x[57:64]')}) AS b FROM x) SELECT id, a > 1e-3 AND b > greatest(0.04, 0.9 * a) AS loud FROM r",
    "tail_rms_summary": f"WITH {X}, r AS (SELECT label, sqrt({POWER.format('x[57:64]')}) AS r FROM x) SELECT label, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.9), 6) AS p90, round(max(r), 6) AS max FROM r GROUP BY label",
    "bottleneck_pick": """WITH b AS (SELECT vec_id AS id, 2000 + (vec_id * 53) % 9000 AS band FROM embeddings)
SELECT id, CASE WHEN band <= 4000 THEN 8000 WHEN band <= 5512.5 THEN 11025 WHEN band <= 6000 THEN 12000 ELSE 16000 END::BIGINT AS rate FROM b""",
}
