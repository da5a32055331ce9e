"""Scores and decisions as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def heuristic(silence: Column) -> Column:
    """A scorer that needs no model: the longer the silence, the likelier the end."""
    return 1 - F.exp(-silence / 0.6)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def two_way_softmax(eot: Column, hold: Column) -> Column:
    """Probability of the first of two logits."""
    return 1 / (1 + F.exp(hold - eot))


def bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy with logits, in its stable form."""
    return F.log1p(F.exp(-F.abs(logit))) + F.greatest(logit, F.lit(0.0)) - logit * label


def decide(p: Column, silence: Column, threshold=0.5, action_delay=0.2, timeout=3.0) -> Column:
    """What a policy does; the timeout comes before the score."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(silence <= 0, "listening").when(silence >= lit(timeout), "end_of_turn (timeout)").when((silence >= lit(action_delay)) & (p >= lit(threshold)), "end_of_turn").otherwise("holding")


def predictor(make: Callable[[], Callable[[list, list], list[float]]]) -> Callable[[Column, Column], Column]:
    """A batch scorer as a column function: make() loads the model once per worker; it maps waveforms and rates to probabilities."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = make()
        for audio, rate in batches:
            yield pd.Series(predict(audio.tolist(), rate.tolist()), dtype="float64")

    return score
