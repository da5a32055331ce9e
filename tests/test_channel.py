"""Filters against poles placed by hand, the channel against a plain restatement, and batches against their rules."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import filters
from cadenza.operators import batches, degrade


def digital(order, cutoff, rate, high):
    """Denominator and numerator of a Butterworth filter, from its poles on the circle, by the bilinear transform."""
    warped = 2 * rate * math.tan(math.pi * cutoff / rate)
    poles = np.array([np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)])
    poles = warped / poles if high else warped * poles
    z = (2 * rate + poles) / (2 * rate - poles)
    b = np.poly([1.0 if high else -1.0] * order)
    a = np.poly(z).real
    at = -1.0 if high else 1.0  # where the gain is 1
    return b * (np.polyval(a, at) / np.polyval(b, at)), a


def filtered(x, order, cutoff, rate, high):
    b, a = digital(order, cutoff, rate, high)
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(order + 1) if i >= k) - sum(a[k] * y[i - k] for k in range(1, order + 1) if i >= k)
    return y


@pytest.mark.parametrize("order, cutoff, high", [(2, 300.0, True), (4, 3100.0, False), (2, 3999.0, True)])
def test_impulse_response(spark, order, cutoff, high):
    x = np.zeros(500)
    x[3] = 1.0
    df = spark.createDataFrame([(x.tolist(), cutoff), ([], cutoff)], "x array<double>, c double")
    got, empty = [r.y for r in df.select(filters.butterworth(F.col("x"), F.col("c"), F.lit(8000.0), order, high).alias("y")).collect()]
    assert np.abs(np.array(got) - filtered(x, order, cutoff, 8000, high)).max() < 1e-6 and empty == []


def unit(text):
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") / 2.0**64


def plain(x, rate, key, c):
    """The channel without noise, in numpy."""
    u = lambda name, low=0.0, high=1.0: low + unit(f"{c.seed}:{key}:{name}") * (high - low)
    interp = lambda v, n: np.interp(np.linspace(0, len(v) - 1, n), np.arange(len(v)), v)
    if u("apply") >= c.apply:
        return x
    band = u("band", *c.band)
    low = next((r for r in c.rates if r / 2 >= band), c.rates[-1])
    y = filtered(x, 2, u("highpass", *c.highpass), rate, True)
    y = interp(y, round(len(x) * low / rate)) if low != rate else y
    y = filtered(y, 4, band, low, False)
    y = y / np.abs(y).max()
    if u("codec") * 0.4 < 0.25:
        code = np.rint((np.sign(y) * np.log1p(255 * np.abs(y)) / np.log1p(255) + 1) / 2 * 255) / 255 * 2 - 1
        y = np.sign(code) * np.expm1(np.abs(code) * np.log1p(255)) / 255
    y = interp(y, len(x)) if low != rate else y
    if u("loss") < c.packet_loss:
        total = len(x) / rate
        for i in range(int(total * 3 / 10)):
            n = 0.02 + unit(f"{c.seed}:{key}:lost{i}") * 0.18
            s = unit(f"{c.seed}:{key}:at{i}") * (total - n)
            if s >= 0:
                y[int(s * rate) : int((s + n) * rate)] = 0
    return np.clip(y, -1, 1)


def test_channel_equals_plain_restatement(spark):
    rng = np.random.default_rng(2)
    waves = [(k, (rng.standard_normal(300) * 0.1).tolist(), 40 if k % 2 else 8000) for k in range(8)]
    c = degrade.Channel(noise=0.0, packet_loss=0.6, seed=3)
    slow = degrade.Channel(noise=0.0, packet_loss=0.6, seed=3, highpass=(2.0, 3.0), band=(8.0, 12.0), rates=(20, 25, 40))
    seen = set()
    for channel, rate in ((c, 8000), (slow, 40)):
        some = [w for w in waves if w[2] == rate]
        rows = degrade.degraded(spark.createDataFrame([*some, (99, None, rate), (98, [], rate)], "id long, samples array<float>, rate int"), channel).collect()
        for r in rows:
            if r.id >= 98:
                assert not r.samples and r.trace.applied is False
                continue
            want = plain(np.float32(some[[w[0] for w in some].index(r.id)][1]).astype(float), rate, r.id, channel)
            assert np.abs(np.array(r.samples) - want).max() < 1e-5
            seen.add((r.trace.applied, r.trace.codec, r.trace.packet_loss))
    assert len(seen) >= 3


def test_noise_has_its_ratio(spark):
    x = [math.sin(k / 3) for k in range(4000)]
    df = spark.createDataFrame([(x,)], "x array<double>").select(degrade.normal(F.lit("k"), F.lit(4000), 1).alias("z"))
    z = np.array(df.first().z)
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and len(set(z.tolist())) == 4000


def test_codecs_renormalise(spark):
    c = degrade.Channel(encoders=("gsm",))
    df = spark.range(4000).select((F.col("id") / 4000).alias("u"), F.when(F.col("id") % 2 == 0, 8000).otherwise(16000).alias("rate"))
    got = {(r.rate, r.codec): r["count"] for r in df.select("rate", degrade.codec(F.col("u"), F.col("rate"), c).alias("codec")).groupBy("rate", "codec").count().collect()}
    assert got == {(8000, "gsm"): 1200, (8000, "mulaw"): 500, (8000, "none"): 300, (16000, "mulaw"): 1250, (16000, "none"): 750}


@pytest.mark.parametrize("prefix", [0, 1])
def test_batches_keep_their_budget(spark, prefix):
    rows = [(k, [None, 0, 5, 90, 130, 40][k % 6]) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, n int")
    got = batches.by_budget(df, "id", "n", 100, prefix=prefix).orderBy("batch", "place").collect()
    assert sorted(r.id for r in got) == [k for k, n in rows if n]
    of = {}
    for r in got:
        assert r.start == sum(n for _, n in of.get(r.batch, [])) and r.place == len(of.get(r.batch, []))
        of.setdefault(r.batch, []).append((r.id, r.n))
    assert sorted(of) == list(range(len(of)))
    assert all(sum(n for _, n in b) <= 100 or len(b) == 1 for b in of.values())
    if prefix == 0:  # greedy: the next example would not have fitted
        assert all(sum(n for _, n in of[b]) + of[b + 1][0][1] > 100 for b in range(len(of) - 1))
    assert batches.by_budget(df.where("id < 2"), "id", "n", 100).count() == 0
    assert [batches.digits(n) for n in (0, 512, 513, 16 * 512, 16 * 512 + 1)] == [0, 0, 1, 1, 2]
