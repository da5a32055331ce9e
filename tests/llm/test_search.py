"""Ranked search against a plain scan of all documents, over many shards, with ties, repeated rows and odd items."""

import math
import random
import re
from collections import Counter

import pytest

from cadenza.llm import ranked_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def model(documents, items, k):
    known = [(-(1 << 63) if d is None else d, Counter(terms(t))) for d, t in documents]
    known = [(d, c, sum(c.values())) for d, c in known if c]
    n, total = len(known), sum(x[2] for x in known)
    df = Counter(w for _, c, _ in known for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, length in known:
            m = 75 + 25 * length * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in Counter(terms(text)).items() if w in c)
            if s > 0:
                scored.append((-s, d))
        out += [(item, r + 1, None if d == -(1 << 63) else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit, k, items_bytes", [(2 << 20, 20, 4 << 20), (3_000, 3, 200)])
def test_equals_plain_scan(spark, odd, monkeypatch, limit, k, items_bytes):
    """Shards of a few documents let the score to reach rise along the way; blocks of items are searched one by one."""
    monkeypatch.setattr(S, "slices", lambda batch: __import__("cadenza.llm.kernels", fromlist=["slices"]).slices(batch, "text", limit))
    monkeypatch.setattr(S, "ITEM_BYTES", items_bytes)
    rng = random.Random(13)
    vocabulary = [f"t{j}" for j in range(60)]
    zipf = [1 / (j + 1) for j in range(60)]
    documents = [(i, t) for i, t in odd] + [(1000 + i, " ".join(rng.choices(vocabulary, zipf, k=rng.randrange(1, 90)))) for i in range(300)]
    documents += [documents[-1], (None, "t1 t2 T3 lone"), (5000, documents[-2][1])]  # a row twice, no key, a copy
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(25)]
    items += [(30, None), (31, " .,; "), (32, "nowhere"), (33, "T1 t1 t1, T2!"), (34, "日本語"), (35, odd[10][1]), (35, "t5 other text of one id"), (None, "t7 lone")]
    shards = S.index(spark.createDataFrame(documents, "doc_id long, text string").repartition(2))
    found = S.search(shards, spark.createDataFrame([*items, items[0]], "item_id long, text string"), k)
    assert sorted(map(tuple, found.collect()), key=repr) == model(documents, items, k)


def test_query_on_odd_and_empty_tables(spark, documents, nothing, tmp_path):
    items = spark.createDataFrame([(1, "One two"), (2, "")], "item_id long, text string")
    for name, table in (("odd", documents), ("none", nothing)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted(map(tuple, S.op13_ranked_search(spark, f"{tmp_path}/odd").collect()), key=repr)
    assert got == model(rows, [(1, "One two")], 20) and got
    assert S.op13_ranked_search(spark, f"{tmp_path}/none").collect() == []
    assert S.search(S.index(documents), items.limit(0)).collect() == []


def test_non_essential_lists_are_only_probed():
    """With a floor that common terms can't reach, documents that hold only those are never scored."""
    import numpy as np
    import pyarrow as pa

    texts = [f"common{' rare' if i % 50 == 0 else ''} x{i}" for i in range(500)]
    batch = pa.RecordBatch.from_pydict({"_id": pa.array(range(500)), "text": pa.array(texts)})
    own = S.Shard(S.shard(batch), pa.array(["common", "rare"], pa.large_string()), 500, 1010)
    item = {0: 1, 1: 3000}
    floor = item[0] * own.bound[0] + 1
    docs, scores = S.searched(own, item, floor)
    assert docs.tolist() == list(range(0, 500, 50)) and 1 in own.lists
    full, all_scores = S.searched(own, item, 1)
    assert len(full) == 500 and np.array_equal(all_scores[docs], scores)
    assert len(S.searched(own, item, 1 << 60)[0]) == 0


def test_the_index_is_held_a_few_shards_at_a_time(spark, tmp_path):
    """A task's shards are many small row groups without whole values as statistics, and the settings of the session are as before."""
    import pathlib

    import pyarrow.parquet as pq

    settings = dict(spark.conf.getAll)
    rng = random.Random(3)
    texts = [(i, " ".join(str(rng.randrange(10**9)) for _ in range(150_000))) for i in range(16)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[5][1][:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(folder.glob("cadenza-shards-*"))
    best = S.op13_ranked_search(spark, str(tmp_path)).orderBy("rank").first()
    assert best.doc_id == 5 and dict(spark.conf.getAll) == settings
    (table,) = set(folder.glob("cadenza-shards-*")) - known
    footers = [pq.ParquetFile(f).metadata for f in table.glob("*.parquet")]
    groups = [m.row_group(k) for m in footers for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 16 and max(g.num_rows for g in groups) <= 4
    assert not any(g.column(k).is_stats_set for g in groups for k in range(g.num_columns))
