"""Densities, valleys and percentiles against a plain restatement in numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cadenza.operators import gaps as G
from cadenza.operators import quantiles as Q

#: Gaps in seconds with their counts: two hills with a valley at 0.4, one hill, a flat line.
HILLS = {0.04: 1, 0.08: 6, 0.1: 30, 0.12: 8, 0.2: 2, 0.4: 1, 0.8: 3, 1.0: 12, 1.25: 4, 3.0: 1}
ONE = {0.05: 1, 0.24: 9, 0.25: 20, 0.26: 9, 1.4: 1}
FLAT = {0.3: 40}


def frame(spark, counts):
    return spark.createDataFrame([(v,) for v, n in counts.items() for _ in range(n)], "gap double")


def restated(counts, floor, grid=200, width=0.12):
    """Grid and density; the two highest peaks, lowest place between."""
    x = np.log10([v for v, n in counts.items() if v >= floor for _ in range(n)])
    at = np.linspace(x.min(), x.max(), grid)
    d = np.exp(-0.5 * ((at[:, None] - x) / width) ** 2).sum(1) / (len(x) * width * np.sqrt(2 * np.pi))
    d = d.round(9)
    inner = range(1, grid - 1)
    peaks = sorted((i for i in inner if d[i - 1] < d[i] >= d[i + 1]), key=lambda i: (-d[i], i))[:2]
    troughs = [i for i in inner if d[i - 1] > d[i] <= d[i + 1] and len(peaks) == 2 and min(peaks) < i < max(peaks)]
    return at, d, sorted(peaks), min(troughs, key=lambda i: (d[i], i), default=None)


@pytest.mark.parametrize("counts", [HILLS, ONE])
def test_density_and_valley(spark, counts):
    at, d, peaks, trough = restated(counts, 0.05)
    got = G.density(frame(spark, counts), 0.05).orderBy("i").collect()
    assert np.allclose([r.x for r in got], at) and np.allclose([r.density for r in got], d, atol=2e-9)
    r = G.valley(frame(spark, counts), 0.05).first()
    kept = [v for v, n in counts.items() if v >= 0.05 for _ in range(n)]
    assert r.n_gaps == len(kept)
    assert r.mode_low == pytest.approx(10 ** at[peaks[0]], abs=1e-6)
    if trough is None:
        assert r.valley is None and r.recommended == pytest.approx(np.percentile(kept, 75), abs=1e-6)
    else:
        assert r.mode_high == pytest.approx(10 ** at[peaks[1]], abs=1e-6) and r.valley == pytest.approx(10 ** at[trough], abs=1e-6) and r.recommended == round(r.valley, 3)


def test_no_density(spark):
    """Equal gaps, and fewer than twenty, have no curve; without any the floor decides."""
    assert G.density(frame(spark, FLAT), 0.1).count() == 0 and G.density(frame(spark, {0.2: 9, 0.3: 10}), 0.1).count() == 0
    r = G.valley(frame(spark, FLAT), 0.1).first()
    assert (r.n_gaps, r.mode_low, r.valley, r.recommended) == (40, None, None, 0.3)
    r = G.valley(frame(spark, {}), 0.25).first()
    assert (r.n_gaps, r.mode_low, r.valley, r.recommended) == (0, None, None, 1.25)
    assert [x.n for x in G.log_histogram(frame(spark, {}), 0.02).collect()] == [0] * 30


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-3, 4000).map(lambda k: k / 8))), max_size=60))
def test_percentiles_of_any_rows(spark, rows):
    shares = (0.0, 0.1, 0.5, 0.95, 1.0)
    got = {r.g: (r.n, r.q) for r in Q.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()}
    want = {}
    for g, x in rows:
        if x is not None:
            want.setdefault(g, []).append(x)
    assert got.keys() == want.keys()
    for g, x in want.items():
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.percentile(x, [100 * p for p in shares]))
