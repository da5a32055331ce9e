"""Filters and the telephone channel over short waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import filters as W
from cadenza.operators import degrade as D
from cadenza.plans.waves import waves

RATE = 16000
CHANNEL = D.Channel(packet_loss=0.3, seed=5)


def filter_highpass(spark, sf_dir):
    """Samples at 16 kHz through a high-pass of 200 to 349 Hz, by the row."""
    y = W.highpass(F.col("x"), (200 + F.col("id") % 150).cast("double"), F.lit(float(RATE)))
    return waves(spark, sf_dir).select("id", F.posexplode(y).alias("i", "y")).select("id", F.col("i").cast("long").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


def filter_lowpass(spark, sf_dir):
    """Samples at 16 kHz through a low-pass of 2800 to 4199 Hz, by the row."""
    y = W.lowpass(F.col("x"), (2800 + F.col("id") % 1400).cast("double"), F.lit(float(RATE)))
    return waves(spark, sf_dir).select("id", F.posexplode(y).alias("i", "y")).select("id", F.col("i").cast("long").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


def channel_trace(spark, sf_dir):
    """What the channel chooses for each row."""
    t = waves(spark, sf_dir).select("id", D.trace(F.col("id").cast("string"), CHANNEL).alias("t"))
    return t.select("id", "t.applied", *(F.round(f"t.{c}", 6).alias(c) for c in ("highpass", "band", "snr")), "t.rate", "t.codec", "t.packet_loss")


def packet_loss(spark, sf_dir):
    """Samples that are left at 8 a second, of which two intervals are lost."""
    y = D.lost(F.col("x"), D.losses(F.col("id").cast("string"), F.size("x") / F.lit(8.0), 5), F.lit(8.0))
    return waves(spark, sf_dir).select("id", F.posexplode(y).alias("i", "y")).select("id", F.col("i").cast("long").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


def drawn(name: str, key: str = "vec_id", seed: int = 5) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key} || ':{name}'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def recursion(cutoff: str, order: int, high: bool) -> str:
    """The filter's sections one after another, sample by sample, as a recursive table ``heard`` (id, i, y)."""
    qs = W.qualities(order)
    k = f"tan(pi() * ({cutoff}) / {RATE}.0::DOUBLE)"
    sets = []
    for s, q in enumerate(qs):
        norm = f"(1 / (1 + k / {q!r}::DOUBLE + k * k))"
        b0 = norm if high else f"(k * k * {norm})"
        sets.append(f"{b0} AS b{s}, 2 * (k * k - 1) * {norm} AS a{s}, (1 - k / {q!r}::DOUBLE + k * k) * {norm} AS c{s}")
    sign = -2 if high else 2
    inner, last, nexts, zeros, carried = "SELECT h.*, w.xs[h.i + 2]::DOUBLE AS in0, w.n FROM heard h JOIN w USING (id) WHERE h.i + 1 < w.n", "in0", [], [], []
    for s in range(len(qs)):
        inner = f"SELECT *, b{s} * {last} + z{s} AS in{s + 1} FROM ({inner})"
        nexts += [f"{sign} * b{s} * in{s} - a{s} * in{s + 1} + v{s}", f"b{s} * in{s} - c{s} * in{s + 1}"]
        zeros += [f"0.0::DOUBLE AS z{s}", f"0.0::DOUBLE AS v{s}"]
        carried += [f"b{s}", f"a{s}", f"c{s}"]
        last = f"in{s + 1}"
    return f"""w AS (SELECT vec_id AS id, embedding AS xs, len(embedding) AS n, {k} AS k FROM embeddings),
heard AS (
  SELECT id, -1::BIGINT AS i, 0.0::DOUBLE AS y, {', '.join(zeros)}, {', '.join(sets)} FROM w
  UNION ALL
  SELECT id, i + 1, {last}, {', '.join(nexts)}, {', '.join(carried)} FROM ({inner}))"""


QUERIES = {f.__name__: f for f in (filter_highpass, filter_lowpass, channel_trace, packet_loss)}
SQL = {
    "filter_highpass": f"WITH RECURSIVE {recursion('200 + vec_id % 150', 2, True)} SELECT id, i, round(y, 6) + 0.0 AS y FROM heard WHERE i >= 0",
    "filter_lowpass": f"WITH RECURSIVE {recursion('2800 + vec_id % 1400', 4, False)} SELECT id, i, round(y, 6) + 0.0 AS y FROM heard WHERE i >= 0",
    "channel_trace": f"""WITH d AS (
  SELECT vec_id AS id, {drawn('apply')} < 0.7::DOUBLE AS applied, 200 + {drawn('highpass')} * 150 AS highpass, 2800 + {drawn('band')} * 1400 AS band,
         CASE WHEN {drawn('noise')} < 0.85::DOUBLE THEN 8 + {drawn('snr')} * 20 END AS snr, {drawn('codec')} * 0.4::DOUBLE < 0.25::DOUBLE AS coded, {drawn('loss')} < 0.3::DOUBLE AS lost FROM embeddings)
SELECT id, applied, CASE WHEN applied THEN round(highpass, 6) END AS highpass, CASE WHEN applied THEN round(band, 6) END AS band, CASE WHEN applied THEN round(snr, 6) END AS snr,
       CASE WHEN NOT applied THEN NULL WHEN band <= 4000 THEN 8000 ELSE 11025 END AS rate, CASE WHEN NOT applied THEN NULL WHEN coded THEN 'mulaw' ELSE 'none' END AS codec, applied AND lost AS packet_loss FROM d""",
    "packet_loss": f"""WITH w AS (SELECT vec_id, embedding, len(embedding) / 8.0::DOUBLE AS total FROM embeddings),
cuts AS (
  SELECT vec_id, total, k, 0.02::DOUBLE + {drawn("lost' || k || '")} * 0.18::DOUBLE AS n, {drawn("at' || k || '")} AS u FROM w, (SELECT unnest(range(0, 100)) AS k) WHERE k < floor(total * 3 / 10)),
gone AS (SELECT vec_id, trunc(u * (total - n) * 8)::BIGINT AS a, trunc((u * (total - n) + n) * 8)::BIGINT AS b FROM cuts WHERE u * (total - n) >= 0),
s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS i FROM w)
SELECT vec_id AS id, i, round(CASE WHEN EXISTS (SELECT 1 FROM gone g WHERE g.vec_id = s.vec_id AND i >= a AND i < b) THEN 0 ELSE y END, 6) + 0.0 AS y FROM s""",
}
