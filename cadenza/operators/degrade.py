"""A telephone channel for training audio in columns, the same for a row wherever and however often it runs.

Every choice is a hash of the seed, the row's id and the choice's name, so the trace can be had without the samples. Codecs that need an outside encoder
are taken as not available, and their weight goes to the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import filters, waves
from cadenza.functions.waves import let
from cadenza.operators.examples import unit


@dataclass(frozen=True)
class Channel:
    apply: float = 0.7
    highpass: tuple[float, float] = (200.0, 350.0)
    band: tuple[float, float] = (2800.0, 4200.0)
    rates: tuple[int, ...] = (8000, 11025, 12000, 16000)
    codecs: tuple[tuple[str, float], ...] = (("gsm", 0.6), ("mulaw", 0.25), ("none", 0.15))
    encoders: tuple[str, ...] = ()  # outside ones that are there; gsm needs one, and 8000 Hz
    noise: float = 0.85
    snr: tuple[float, float] = (8.0, 28.0)
    packet_loss: float = 0.0
    seed: int = 0


def draw(key: Column, name: str, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) for a row's choice."""
    return low + unit(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{name}"))) * (high - low)


def picked(u: Column, weighted: list[tuple[str, float]]) -> Column:
    """The first name whose cumulative share of the weights is above u; "none" of nothing."""
    total, below = sum(w for _, w in weighted), 0.0
    if not weighted or total <= 0:
        return F.lit("none")
    out = None
    for name, w in weighted[:-1]:
        below += w
        hit = u * total < below
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(weighted[-1][0]) if out is None else out.otherwise(weighted[-1][0])


def codec(u: Column, rate: Column, c: Channel) -> Column:
    """The codec at a rate: gsm at 8000 Hz alone, and where it can be encoded; the others share its weight."""
    rest = [x for x in c.codecs if x[0] != "gsm"]
    if "gsm" not in c.encoders:
        return picked(u, rest)
    return F.when(rate == 8000, picked(u, list(c.codecs))).otherwise(picked(u, rest))


def trace(key: Column, c: Channel) -> Column:
    """What is chosen for a row: applied, highpass, band, rate, codec, snr, packet_loss."""
    d = lambda name, *between: draw(key, name, c.seed, *between)

    def told(band: Column) -> Column:
        rate = waves.bottleneck(band, c.rates)
        snr = F.when(d("noise") < c.noise, d("snr", *c.snr))
        return F.struct(
            F.lit(True).alias("applied"), d("highpass", *c.highpass).alias("highpass"), band.alias("band"), rate.cast("int").alias("rate"),
            codec(d("codec"), rate, c).alias("codec"), snr.alias("snr"), (d("loss") < c.packet_loss).alias("packet_loss"),
        )

    some = let(d("band", *c.band), told)
    kind = "struct<applied:boolean,highpass:double,band:double,rate:int,codec:string,snr:double,packet_loss:boolean>"
    none = F.from_json(F.lit('{"applied":false,"packet_loss":false}'), kind)
    return F.when(d("apply") < c.apply, some.cast(kind)).otherwise(none)


def losses(key: Column, seconds: Column, seed: int) -> Column:
    """Intervals (start, end) in seconds that get lost: three in ten seconds, of 20 to 200 ms each; one that does not fit ends them."""
    count = F.floor(seconds * 3 / 10).cast("int")
    u = lambda name, i: unit(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{name}"), i.cast("string")))

    def one(i: Column) -> Column:
        return let(0.02 + u("lost", i) * 0.18, lambda n: let(u("at", i) * (seconds - n), lambda s: F.struct(s.alias("start"), (s + n).alias("end"))))

    every = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<struct<start:double,end:double>>"))
    return F.filter(every, lambda x: x["start"] >= 0)


def lost(x: Column, intervals: Column, rate: Column) -> Column:
    """Samples with those of the intervals at zero."""
    cut = F.transform(intervals, lambda v: F.struct((v["start"] * rate).cast("long").alias("i"), (v["end"] * rate).cast("long").alias("j")))
    return let(cut, lambda cuts: F.transform(x, lambda v, k: F.when(F.exists(cuts, lambda c: (k >= c["i"]) & (k < c["j"])), F.lit(0.0)).otherwise(v.cast("double"))))


def normal(key: Column, n: Column, seed: int) -> Column:
    """n samples of standard normal noise by hashes of the seed, the key and the place."""
    u = lambda i, k: (F.pmod(F.xxhash64(i, key, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    one = lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * math.pi * u(i, 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def unit_peak(x: Column) -> Column:
    return let(F.array_max(F.transform(x, lambda v: F.abs(v))), lambda p: F.when(p > 1e-6, F.transform(x, lambda v: v / p)).otherwise(x))


def channel(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (id, x, rate, trace) with x through what the trace tells: high-pass, down to the bottleneck, low-pass, full scale, codec, noise, back to the rate, losses.

    Each step is a column of its own, which the next ones read.
    """
    t, x, rate, key = F.col("trace"), F.col("_x"), F.col("rate"), F.col("id").cast("string")
    same = t["rate"] == rate
    rows = rows.withColumn("_n", F.size("_x"))
    rows = rows.withColumn("_x", filters.highpass(x, t["highpass"], rate))
    rows = rows.withColumn("_x", F.when(same, x).otherwise(waves.resampled(x, F.rint(F.col("_n") * t["rate"] / rate).cast("int"))))
    rows = rows.withColumn("_x", filters.lowpass(x, t["band"], t["rate"]))
    rows = rows.withColumn("_x", unit_peak(x))
    rows = rows.withColumn("_x", F.when(t["codec"] == "mulaw", waves.mu_law(x)).otherwise(x))
    rows = rows.withColumn("_z", F.when(t["snr"].isNotNull(), normal(key, F.size("_x"), seed)))
    rows = rows.withColumn("_x", F.when(t["snr"].isNotNull(), waves.mixed(x, F.col("_z"), t["snr"])).otherwise(x))
    rows = rows.withColumn("_x", F.when(same, x).otherwise(waves.resampled(x, F.col("_n"))))
    return rows.withColumn("_x", F.when(t["packet_loss"], lost(x, losses(key, F.col("_n") / rate, seed), rate)).otherwise(x)).drop("_n", "_z")


def degraded(rows: DataFrame, channel_: Channel = Channel()) -> DataFrame:
    """(id, samples, rate) rows with the channel's output in place of samples, and ``trace``.

    What is not finite becomes 0, and samples stay within 1. Empty samples stay so, and a null stays null; their trace tells that nothing was applied.
    """
    some = F.coalesce(F.size("samples"), F.lit(0)) > 0
    finite = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    traced = rows.select("id", "samples", "rate", trace(F.when(some, F.col("id").cast("string")), channel_).alias("trace"))
    through = channel(traced.withColumn("_x", F.when(F.col("trace.applied"), F.transform("samples", lambda v: finite(v.cast("double"))))), channel_.seed)
    clipped = F.transform("_x", lambda v: F.greatest(F.least(finite(v), F.lit(1.0)), F.lit(-1.0)).cast("float"))
    return through.select("id", F.when(F.col("trace.applied"), clipped).otherwise(F.col("samples").cast("array<float>")).alias("samples"), "rate", "trace")
