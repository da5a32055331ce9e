"""Hard negatives against brute force: clusters, ties, copies, zeros, odd rows, and many groups and parts."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, part string, grp string, v string, far string"


def model(rows, every, k_pos, k_neg, low, high):
    """rows: (id, label, integers), each id once."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731,B905  the shorter ends the sum
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        scored = [(-dot(v, w), j, other) for j, other, w in rows if j != i]
        for ps, p, _ in sorted(x for x in scored if x[2] == label)[:k_pos]:
            fit = sorted(x for x in scored if x[2] != label and low * -ps <= 100 * -x[0] <= high * -ps)[:k_neg]
            out += [(i, p, n + 1, j, -ps, -s) for n, (s, j, _) in enumerate(fit)]
    return sorted(out)


def kinds(rng, n, dim):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = centres[min(rng.randrange(6), 3)]  # one cluster holds half of all
        v = [x + rng.gauss(0, 0.3) for x in c]
        if i % 17 == 0:
            v = [0.0] * dim
        if i % 5 == 0 and i:
            v = list(rows[rng.randrange(i)][2])  # copies, and with them ties
        rows.append((i, rng.randrange(5) if i % 3 else 0, v))
    return rows


@pytest.mark.parametrize("anchors, parts", [(1024, 32_768), (7, 40)])
def test_equals_brute_force(spark, monkeypatch, anchors, parts):
    monkeypatch.setattr(H, "ANCHORS", anchors)
    monkeypatch.setattr(H, "ROWS", parts)
    rows = [(i, label, [round(64 * x) for x in v]) for i, label, v in kinds(random.Random(3), 400, 6)]
    rows.append((1000, 2, rows[40][2][:4]))  # shorter
    df = spark.createDataFrame(rows, "id long, label int, v array<long>")
    got = sorted(map(tuple, H.hard_negatives(df, F.col("id") % 4 == 0, 3, 4, 70, 95).collect()))
    assert got == model(rows, 4, 3, 4, 70, 95) and len(got) > 300


def test_ranges_leave_far_cells_out(spark, monkeypatch):
    """Clusters far from each other: candidates do not reach all groups."""
    rng = random.Random(4)
    rows = [(i, i % 3, [(1000 if j == i % 8 else 0) + rng.randrange(-9, 10) for j in range(8)]) for i in range(800)]
    seen = []
    met = H.Join.met

    def watched(self, anchors, by_label, local, schema):
        seen.append((self.bounds(anchors, by_label).count(), anchors.select("grp", *["label"] * by_label).distinct().count(), len(self.space.pivots)))
        return met(self, anchors, by_label, local, schema)

    monkeypatch.setattr(H.Join, "met", watched)
    monkeypatch.setattr(H, "ANCHORS", 10)
    df = spark.createDataFrame(rows, "id long, label int, v array<long>")
    got = sorted(map(tuple, H.hard_negatives(df, F.col("id") % 10 == 0, 2, 3, pivots=40).collect()))
    assert got == model(rows, 10, 2, 3, 80, 100)
    assert all(kept < 0.7 * groups * pivots for kept, groups, pivots in seen), seen


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 0), (7, [0.9, 0.5], 0), (14, [0.9, 0.4], 9), (1, [0.9, 0.5], 2), (2, [0.8, 0.5], 1), (2, [0.8, 0.5], 1), (3, [0.1, nan], 1), (4, [inf, 0.0], 2), (5, None, 3), (6, [0.9, None], 3), (8, [0.9, 0.3], None), (None, [0.9, 0.3], 1), (100, [], 4), (200, [-1.0, 0.0], 0), (9, [0.7, 0.7], 1)]
    df = spark.createDataFrame([(*r, "c", "p", "g", "v", "f") for r in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    right = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and abs(x) < inf for x in v):
            right[i] = (i, (label + 1) % 10 if i % 7 == 0 else label, [int(256 * x // 1) for x in (float(__import__("numpy").float32(x)) for x in v)])
    got = sorted(map(tuple, H.op12_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == model(list(right.values()), 100, 5, 5, 80, 100) and got
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert H.op12_hard_negatives(spark, f"{tmp_path}/none").collect() == []


def test_large_components_stay_exact():
    import numpy as np

    a, b = np.array([[1 << 28, 1]], np.int64), np.array([[1 << 28, 1]], np.int64)
    assert H.products(a, b)[0, 0] == (1 << 56) + 1


def test_shares():
    assert H.dealt({0: 5, 1: 5, 2: 25, 3: 1}, [0, 1, 2, 3], 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1)]
