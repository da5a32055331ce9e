"""Substring, suffix and near-duplicate removal against brute force."""

import collections
import hashlib

import numpy as np
import pytest

from cadenza.llm import minhash_dedup, substring_dedup, suffix_dedup

NULL = -(1 << 63)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows_of(df):
    return [(NULL if r.doc_id is None else r.doc_id, r.text) for r in df.collect()]


def substring_model(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def suffix_model(rows, size):
    count = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[p : p + size] for p in range(len(b) - size + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def near_model(rows, size, percent):
    sets = []
    for _, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(rows, label, strict=True):
        least[v] = min(least.get(v, i), i)
    return sorted((i, len(s), least[v], least[v] == i) for (i, _), s, v in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize("window", [5, 20])
def test_substring(spark, documents, window):
    got = sorted((NULL if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.cut_words(documents, window).collect())
    assert got == substring_model(rows_of(documents), window)


@pytest.mark.parametrize("size", [40, 200])
def test_suffix(spark, documents, size):
    got = sorted((NULL if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_texts(documents, size).collect())
    assert got == suffix_model(rows_of(documents), size)


def test_suffix_keeps_columns_and_characters(spark, documents):
    out = suffix_dedup.without_repeats(documents)
    assert out.dtypes == documents.dtypes
    rows = {r.doc_id: r for r in out.collect()}
    before = {r.doc_id: r for r in documents.collect()}
    assert out.count() == documents.count() and rows[0].text is None and rows[2].text == before[2].text
    for k, r in rows.items():
        assert r.text is None or (len(r.text) <= len(before[k].text) and r.n_chars in (len(r.text), before[k].n_chars))
    passage = before[13].text.split()[40:100]
    assert all(" ".join(passage) not in (r.text or "") for r in rows.values())


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, documents, size):
    got = sorted((r._id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(documents, size).collect())
    assert got == near_model(rows_of(documents), size, 80)


def test_one_of_each(spark, documents):
    out = minhash_dedup.one_of_each(documents)
    assert out.dtypes == documents.dtypes
    kept = {i for i, _, _, k in near_model(rows_of(documents), 5, 80) if k}
    assert sorted(NULL if r.doc_id is None else r.doc_id for r in out.collect()) == sorted(kept)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group that no task holds whole: links across blocks are found."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_SETS", 10)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[: k % 60] + [f"e{k}"] + base[k % 60 + 1 :])) for k in range(60)]
    rows += [(100 + k, " ".join(f"o{k}x{j}" if j % 3 == 0 else base[j] for j in range(120))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r._id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, 4).collect())
    assert got == near_model(rows, 4, 80)


def test_empty_tables(spark, nothing):
    assert substring_dedup.cut_words(nothing).count() == 0
    assert suffix_dedup.cut_texts(nothing).count() == 0
    assert minhash_dedup.near_duplicates(nothing).count() == 0
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_kept_index(spark):
    """Batches enter one after another; only what older batches hold is told, and levels merge."""
    passage = " ".join(f"p{k}" for k in range(80))
    index, told = suffix_dedup.Index(), []
    for n in range(4):
        rows = [(10 * n + k, f"{n} {k} " + " ".join(f"u{n}x{k}x{j}" for j in range(60)) + (" " + passage if k == 0 and n != 1 else "")) for k in range(3)]
        found = index.add(spark.createDataFrame(rows, "doc_id long, text string"))
        told.append(sorted(r._id for r in found.collect()))
        assert [k for k in range(3) if n + 1 >> k & 1] == sorted(index.levels)
    assert told == [[], [], [20], [30]]


def test_levels_hold_sorted_counts(spark):
    """A level is what one array of all its batches would be."""
    rows = [[(0, [5, 5, 9]), (1, [2])], [(0, [9, 1])], [(0, [7]), (2, [4, 4])]]
    pack = lambda x, t: bytearray(suffix_dedup.pack(np.array(x, t)))
    batches = [spark.createDataFrame([(b, 1, pack(x, np.uint64), pack([1] * len(x), np.uint32)) for b, x in batch], "bucket long, kind int, a binary, c binary") for batch in rows]
    index, seen = suffix_dedup.Index(), []
    read = lambda df: {r.bucket: suffix_dedup.unpack(bytes(r.a), np.uint64).tolist() for r in df.collect()}
    for batch in batches:
        within, shared = index.enter(batch)
        seen.append((read(within), read(shared)))
    assert seen == [({0: [5]}, {}), ({}, {0: [9]}), ({2: [4]}, {})]
    level = {r.bucket: (suffix_dedup.unpack(bytes(r.a), np.uint64).tolist(), suffix_dedup.unpack(bytes(r.c), np.uint32).tolist()) for r in index.levels[1].collect()}
    assert level == {0: ([1, 5, 9], [1, 2, 2]), 1: ([2], [1])} and sorted(index.levels) == [0, 1]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 62, 3000, dtype=np.uint64), rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    one, two = np.unique(a), np.unique(np.concatenate([a[500:], b]))
    r = minhash_dedup.registers(np.concatenate([one, two, np.union1d(one, two)]), np.cumsum([0, len(one), len(two), len(np.union1d(one, two))]))
    assert (minhash_dedup.merge(r[0], r[1]) == r[2]).all()
    true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    got = minhash_dedup.similarity(r[0], r[1], np.float64(len(one)), np.float64(len(two)))
    assert abs(got - true) < 0.15


def substring_found(spark, rows, window, parts=1):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
    return sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.cut_words(docs, window).collect())


def test_repeats_within_one_chunk(spark):
    """Also where no other chunk holds any of them: equal short documents, a document with a period, the first rows of a table."""
    for n in (20, 21, 31):
        rows = [(k, " ".join(f"w{j}" for j in range(n))) for k in range(2)]
        got = substring_found(spark, rows, 20)
        assert got == substring_model(rows, 20) and got[1][2] == n
    rows = [(0, " ".join(f"w{j % 30}" for j in range(90)))]
    assert substring_found(spark, rows, 20) == substring_model(rows, 20)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for n in (40, 100):
        rows = [(r.doc_id, r.text) for r in table.orderBy("doc_id").limit(n).collect()]
        assert substring_found(spark, rows, 20) == substring_model(rows, 20)


@pytest.mark.parametrize("seed", range(6))
def test_small_tables_however_they_are_dealt(spark, seed):
    """Random tables of few words, in one chunk and in several: the result is that of the rule, not of the partitions."""
    import random

    rng = random.Random(seed)
    rows = [(k, " ".join(f"v{rng.randrange(4)}" for _ in range(rng.randrange(0, 30)))) for k in range(rng.randrange(1, 9))]
    want = substring_model(rows, 6)
    for parts in (1, 3, 8):
        assert substring_found(spark, rows, 6, parts) == want


def test_texts_that_collided_under_known_factors(spark):
    """Pairs that had one value under the hash functions without a key."""
    one, two = "aaaaaaaabbbbbbbb", "jvkqfylhy:wm/=,?"
    got = {r._id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame([(0, one), (1, two)], "doc_id long, text string"), 4).collect()}
    assert got == {0: 0, 1: 1}
    rest = " ".join(f"w{j}" for j in range(19))
    rows = [(k, f"{rest} {w}") for k, w in enumerate((one, two))]
    assert substring_found(spark, rows, 20, 4) == substring_model(rows, 20)
    left, right = "".join(chr(97 + j * j % 23) for j in range(160)), "".join(chr(97 + j * j * j % 19) for j in range(160))
    rows = [(k, left + block + right) for k, block in enumerate((one, "jigzetzm'\"GwEc>p"))]
    cut = suffix_dedup.cut_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id"), 200).collect()
    assert [r.n_removed for r in cut] == [0, 0]


def test_chains_are_independent():
    from cadenza.llm import kernels as K

    data = np.frombuffer(b"aaaaaaaabbbbbbbb one two three and " + b"z" * 90 + b" end", np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    made = [K.word_hashes(data, starts, ends, chain=c) for key in (b"k" * 16, b"l" * 16) for c in K.chains(key)]
    assert len(set(np.concatenate(made).tolist())) == 4 * len(starts)
    again = K.word_hashes(data, starts, ends, chain=K.chains(b"k" * 16)[0])
    assert (again == made[0]).all()


def test_op2_frees_what_is_no_longer_needed(spark, documents):
    """Before the last exchange only the repeats are kept: no table of the index, no shuffle of a job that is over."""
    import os
    import time

    from cadenza.llm.exchange import shared_folder

    def tables():
        return {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("cadenza-")}

    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (found.apply(k).getName() for k in range(found.size())) if x.startswith("shuffle_")}

    spark.range(1).collect()
    old_tables, old_shuffles = tables(), shuffles()
    found = suffix_dedup.repeated_windows(documents, 20)
    assert [x.split("-")[1] for x in tables() - old_tables] == ["repeats"]
    late = time.time() + 30
    while shuffles() - old_shuffles and time.time() < late:  # files go by and by
        time.sleep(0.2)
    assert not shuffles() - old_shuffles
    assert found.count() == documents.count()
