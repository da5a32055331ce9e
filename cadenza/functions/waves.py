"""Waveforms as array columns: everything here stays in the JVM.

Sample counts from seconds round half to even where clips are cut (``rint``), and
truncate where a window or a frame length is meant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_DB = -80.0


def _total(x: Column, of=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + of(v.cast("double")))


def mono(frames: Column) -> Column:
    """Average of the channels of each frame."""
    return F.transform(frames, lambda f: _total(f) / F.size(f))


def from_int16(x: Column) -> Column:
    """Samples beyond 4 in magnitude are taken for 16-bit integers."""
    loud = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))) > 4
    return F.when(loud, F.transform(x, lambda v: v.cast("double") / 32768)).otherwise(F.transform(x, lambda v: v.cast("double")))


def power(x: Column) -> Column:
    return _total(x, lambda v: v * v) / F.size(x)


def rms(x: Column) -> Column:
    return F.sqrt(power(x))


def dbfs(x: Column) -> Column:
    return F.when(F.size(x) == 0, F.lit(-120.0)).otherwise(20 * F.log10(rms(x) + 2e-9))


def resampled(x: Column, n_out: Column) -> Column:
    """Linear interpolation at n_out even places from the first sample to the last."""
    n = F.size(x)
    last = (n - 1).cast("double")

    def at(i):
        place = F.when(n_out == 1, F.lit(0.0)).otherwise(i * last / (n_out - 1))
        low = F.floor(place).cast("int")
        a = F.element_at(x, low + 1).cast("double")
        b = F.element_at(x, F.least(low + 2, n)).cast("double")
        return a + (b - a) * (place - low)

    return F.when(n_out > 0, F.transform(F.sequence(F.lit(0), n_out - 1), at)).otherwise(F.array().cast("array<double>"))


def cut(x: Column, first: Column, last: Column) -> Column:
    """Samples [first, last), zeros where the clip has none; first below 0 counts as 0."""
    first = F.greatest(first, F.lit(0))
    want = F.greatest(last - first, F.lit(0))
    have = F.slice(x, first + 1, want)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(want - F.size(have), F.lit(0)))
    return F.concat(have.cast("array<float>"), zeros)


def recent(x: Column, count: Column) -> Column:
    """The last count samples."""
    return F.slice(x, F.greatest(F.lit(1), F.size(x) - count + 1), count)


def framed(x: Column, length: int, hop: int) -> Column:
    """Whole frames of a fixed length."""
    n = F.floor((F.size(x) - length) / hop)
    return F.when(F.size(x) >= length, F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: F.slice(x, (k * hop + 1).cast("int"), length))).otherwise(F.array().cast("array<array<float>>"))


def let(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda's variable is not put in where it is used, as a column's expression is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def percentile(values: Column, p: float) -> Column:
    """Linear percentile of an array, within its row."""

    def of(ordered):
        place = (F.size(ordered) - 1) * F.lit(p)
        low = F.floor(place).cast("int")
        a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, F.size(ordered)))
        return a + (b - a) * (place - low)

    return let(F.array_sort(values), of)


def vad_end(x: Column, length: int, hop: int, ratio: float = 0.1, least: float = 1e-3) -> Column:
    """End sample of the last frame louder than a share of the 95th percentile of loudness: 0 if none is, all samples of a clip shorter than a frame."""

    def last(loud):
        bound = F.greatest(F.lit(least), ratio * percentile(loud, 0.95))
        return let(bound, lambda b: F.array_max(F.transform(loud, lambda v, k: F.when(v > b, k * hop + length))))

    end = let(F.transform(framed(x, length, hop), rms), last)
    return F.when(F.size(x) < length, F.size(x)).otherwise(F.coalesce(end, F.lit(0)))


def trailing_silence(x: Column, length: int, frame_seconds: float, floor_db: float = FLOOR_DB) -> Column:
    """Seconds of quiet whole frames at the end; frames are counted from the start."""
    loud = F.transform(framed(x, length, length), lambda f: dbfs(f) > floor_db)
    n = F.size(loud)
    last = F.coalesce(F.array_max(F.transform(loud, lambda v, i: F.when(v, i))), F.lit(-1))
    return (n - 1 - last) * F.lit(frame_seconds)


def longest_loud_run(x: Column, length: int, floor_db: float = FLOOR_DB) -> Column:
    """Most loud frames in a row."""
    step = F.aggregate(
        F.transform(framed(x, length, length), lambda f: dbfs(f) > floor_db),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, v: F.struct(F.when(v, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(v, s["run"] + 1).otherwise(0)).alias("best")),
    )
    return step["best"]


def mu_law(x: Column) -> Column:
    """A round trip through 256 mu-law codes."""
    mu = 255.0

    def one(v):
        v = F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(-1.0))
        code = F.rint((F.signum(v) * F.log1p(mu * F.abs(v)) / F.log1p(F.lit(mu)) + 1) / 2 * mu)
        y = code / mu * 2 - 1
        return F.signum(y) * F.expm1(F.abs(y) * F.log1p(F.lit(mu))) / mu

    return F.transform(x, one)


def mixed(x: Column, noise: Column, snr_db: Column) -> Column:
    """x with noise of its length scaled to a signal-to-noise ratio."""
    scale = F.sqrt((power(x) + 1e-12) / ((power(noise) + 1e-12) * F.pow(F.lit(10.0), snr_db / 10)))
    return F.zip_with(x, noise, lambda a, b: a.cast("double") + scale * b.cast("double"))


def peak_normalized(x: Column) -> Column:
    peak = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    return F.when(peak > 1e-6, F.transform(x, lambda v: v.cast("double") / peak * 0.95)).otherwise(F.transform(x, lambda v: v.cast("double")))


def bottleneck(band: Column, rates=(8000, 11025, 12000, 16000)) -> Column:
    """The least rate whose Nyquist frequency covers the band, else the largest."""
    table = F.array(*(F.lit(r) for r in sorted(rates)))
    return F.coalesce(F.array_min(F.filter(table, lambda r: r / 2 >= band)), F.array_max(table))
