"""Causal Butterworth filters over sample arrays, as folds in the JVM.

A filter is a cascade of biquads by the bilinear transform, with the cut-off prewarped; each carries two numbers from sample to sample. Samples are
folded in blocks of about the root of their number, so that no step copies the whole output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.waves import let


def qualities(order: int) -> list[float]:
    """The quality of each biquad of an even order."""
    return [1 / (2 * math.cos(math.pi * (2 * k + 1) / (2 * order))) for k in range(order // 2)]


def section(cutoff: Column, rate: Column, q: float, high: bool) -> Column:
    """A biquad's coefficients (b0, b1, b2, a1, a2) by the tangent of the cut-off's angle."""

    def of(k: Column) -> Column:
        norm = 1 / (1 + k / q + k * k)
        b0 = norm if high else k * k * norm
        return F.struct(b0.alias("b0"), ((-2 if high else 2) * b0).alias("b1"), b0.alias("b2"), (2 * (k * k - 1) * norm).alias("a1"), ((1 - k / q + k * k) * norm).alias("a2"))

    return let(F.tan(math.pi * cutoff / rate), of)


def biquad(x: Column, c: Column) -> Column:
    """Samples through one biquad, from rest."""

    def one(s: Column, v: Column, c: Column) -> Column:
        return let(c["b0"] * v + s["z1"], lambda y: F.struct((c["b1"] * v - c["a1"] * y + s["z2"]).alias("z1"), (c["b2"] * v - c["a2"] * y).alias("z2"), F.array_append(s["y"], y).alias("y")))

    def block(s: Column, part: Column, c: Column) -> Column:
        start = F.struct(s["z1"].alias("z1"), s["z2"].alias("z2"), F.array().cast("array<double>").alias("y"))
        done = F.aggregate(part, start, lambda a, v: one(a, v.cast("double"), c))
        return let(done, lambda d: F.struct(d["z1"].alias("z1"), d["z2"].alias("z2"), F.array_append(s["y"], d["y"]).alias("y")))

    def run(c: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int"))
        rest = F.struct(F.lit(0.0).alias("z1"), F.lit(0.0).alias("z2"), F.array().cast("array<array<double>>").alias("y"))
        return F.flatten(F.aggregate(starts, rest, lambda s, k: block(s, F.slice(x, k * width + 1, width), c))["y"])

    return F.when(F.size(x) > 0, let(c, run)).otherwise(F.array().cast("array<double>"))


def butterworth(x: Column, cutoff: Column, rate: Column, order: int, high: bool = False) -> Column:
    """Samples through a Butterworth filter of an even order."""
    def through(y: Column, c: Column) -> Column:
        return let(y, lambda v: biquad(v, c))

    y = x
    for q in qualities(order):
        y = through(y, section(cutoff, rate, q, high))
    return y


def highpass(x: Column, cutoff: Column, rate: Column) -> Column:
    """Order 2; the cut-off stays a hertz below half the rate, and one of 0 or less is none."""
    return F.when(cutoff > 0, butterworth(x, F.least(cutoff, rate / 2 - 1), rate, 2, True)).otherwise(F.transform(x, lambda v: v.cast("double")))


def lowpass(x: Column, cutoff: Column, rate: Column) -> Column:
    """Order 4; a cut-off at half the rate or above, or of 0 or less, is none."""
    return F.when((cutoff > 0) & (cutoff < rate / 2), butterworth(x, cutoff, rate, 4)).otherwise(F.transform(x, lambda v: v.cast("double")))
