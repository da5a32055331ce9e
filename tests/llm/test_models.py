import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, language_id, quality
from cadenza.llm import sentencepiece_codec as S

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = language_id.op7_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, documents, nothing, odd):
    model = language_id.fit(documents.where("lang IS NOT NULL"))
    out = language_id.predict(documents, model)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == documents.count()
    for i, t in odd:
        letters = any(c.isalpha() for c in t or "")
        assert rows[i].lang_pred == ("en" if letters else "und") and (letters or rows[i].score == 0)
    assert language_id.predict(nothing, model).count() == 0
    empty = language_id.fit(nothing)
    assert {(r.lang_pred, r.score) for r in language_id.predict(documents, empty).collect()} == {("und", 0.0)}


def test_language_equals_plain_bayes(spark):
    rows = [("abc abc", "x"), ("abd", "x"), ("zzz yz", "y")]
    names, matrix = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    count = np.full((1 << language_id.BITS, 2), 0.5)
    for t, lang in rows:
        for f in language_id.grams([t])[0]:
            np.add.at(count, (f, names.index(lang)), 1)
    assert names == ["x", "y"] and np.allclose(matrix, np.log(count / count.sum(0)))


def test_quality_held_out(spark):
    got = quality.op10_quality_classifier(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert got.count() == 1000 and sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert got.where((F.col("predicted") == 1) != (F.col("score") >= 0.3)).count() == 0


def test_quality_odd(spark, documents, nothing):
    model = quality.fit(np.zeros((0, quality.WIDTH)), np.zeros((0, quality.WIDTH)))
    out = quality.scored(documents, model, documents.columns, ("_s", "_p"))
    assert out.count() == documents.count() and {r._s for r in out.collect()} == {0.5}
    assert quality.scored(nothing, model, ["doc_id"]).count() == 0
    x = quality.features(pa.array([None, "", "Aa1 \n|$", "the the the"], pa.string()))
    assert x.shape == (4, quality.WIDTH) and not x[0].any() and np.isfinite(x).all() and (x[0] == x[1]).all()


def test_risk_stays_sane_with_few_negatives():
    rng = np.random.default_rng(0)
    pos = rng.normal(1, 1, (600, quality.WIDTH))
    unl = np.concatenate([rng.normal(1, 1, (540, quality.WIDTH)), rng.normal(-1, 1, (60, quality.WIDTH))])
    assert 0.8 <= quality.class_prior(pos, unl) <= 0.98
    s = quality.fit(pos, unl, steps=300).scores(unl)
    assert (s[:540] >= 0.3).mean() > 0.95 and (s[540:] < 0.3).mean() > 0.95


def contained_model(docs, items, size, percent):
    def grams(t, k):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    out = []
    for i, t in items:
        _, n = grams(t, 1)
        if n == 0:
            continue
        own, _ = grams(t, min(size, n))
        for d, x in docs:
            both = len(own & grams(x, min(size, n))[0])
            if 100 * both >= percent * len(own):
                out.append((d, i, len(own), both))
    return sorted(out)


def test_containment(spark, documents, nothing, odd):
    rows = [r for r in documents.select("doc_id", "text").collect() if r.doc_id is not None]
    texts = dict(odd)
    items = [(1, " ".join(texts[13].split()[40:100])), (2, texts[3]), (3, None), (4, ""), (5, "One two three"), (6, " ".join(texts[16].split()[:50] + ["never"] * 9)), (7, texts[7]), (8, "not in any of the documents at all"), (1, " ".join(texts[13].split()[40:100]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    columns = ["_doc", "item_id", "n_item", "n_shared"]
    found = decontaminate.contained(documents.where("doc_id IS NOT NULL"), df).select(*columns).collect()
    assert sorted(tuple(r) for r in found) == contained_model([(r.doc_id, r.text) for r in rows], list(dict.fromkeys(items)), 5, 80)
    assert decontaminate.contained(nothing, df).count() == 0
    assert decontaminate.contained(documents, df.limit(0)).count() == 0


def test_containment_by_joins(spark, documents, nothing, odd):
    items = spark.createDataFrame([(k, t) for k, t in odd[7:20]], "item_id long, text string")
    one, two = (sorted(map(str, decontaminate.contained(documents, items, block_bytes=n).collect())) for n in (1 << 20, 2000))
    assert one == two and one
    assert decontaminate.contained(nothing, items, block_bytes=0).count() == 0


def test_leaks_go_by_their_own_text(spark, nothing):
    """Rows that share a leaking row's doc_id, or have none as it has, stay."""
    item = "the quick brown fox jumps over a lazy dog at noon"
    rows = [(1, f"x {item} y", "a"), (1, "clean", "b"), (None, item, "c"), (None, "clean too", "d"), (None, None, "e"), (2, "", "f"), (3, f"x {item} y", "g"), (3, f"x {item} y", "h")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _th string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    out = decontaminate.without_leaks(docs, items)
    assert out.dtypes == docs.dtypes and sorted(r._th for r in out.collect()) == ["b", "d", "e", "f"]
    assert decontaminate.without_leaks(nothing, items).count() == 0


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_a_polynomial_hash_confuses(spark):
    """A Thue-Morse word and its complement, 1024 and 2048 letters long, are unlike words to every operator."""
    from cadenza.llm import minhash_dedup, substring_dedup

    for n in (1024, 2048):
        one = thue_morse(n)
        two = thue_morse(2 * n)[n:]
        tail = " ".join(f"w{k}" for k in range(19))
        docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, one), (4, two)], "doc_id long, text string")
        assert [r.n_removed for r in substring_dedup.cut_words(docs).collect()] == [0] * 4
        assert all(r.kept for r in minhash_dedup.near_duplicates(docs.where("doc_id > 2")).collect())
        items = spark.createDataFrame([(7, one)], "item_id long, text string")
        assert [r._doc for r in decontaminate.contained(docs.where("doc_id > 2"), items).collect()] == [3]


def test_letters_decide_und(spark, documents):
    """Digits, fractions and circled numbers are no letters; a letter without case is one."""
    model = language_id.fit(documents.where("lang IS NOT NULL"))
    texts = ["½ ² ①", "Ⅷ 12", "٣ ४", "日", "ª", "", None, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: r.lang_pred != "und" for r in language_id.predict(docs, model).collect()} == {k: any(map(str.isalpha, t or "")) for k, t in enumerate(texts)}


def test_many_languages(spark):
    """Beyond 256 languages the buckets halve, and prediction goes on."""
    rows = [(k, chr(0x4E00 + 40 * k) * 30, f"l{k:03}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    names, matrix = language_id.fit(docs)
    assert len(names) == 300 and matrix.shape == (1 << 14, 300) and language_id.width(256) == 15 and language_id.width(513) == 13
    got = language_id.predict(docs, (names, matrix)).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 290


def test_prediction_equals_plain_bayes(spark, documents):
    """Scores from counts of n-grams by a dictionary, text by text."""
    import math

    names, matrix = model = language_id.fit(documents.where("lang IS NOT NULL").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    for r in language_id.predict(documents, model).collect():
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        buckets = [int(b) for f in language_id.grams([r.text])[0] for b in f]
        sums = [math.fsum(matrix[b, k] for b in buckets) for k in range(len(names))]
        top = max(sums)
        assert r.lang_pred == names[sums.index(top)] or abs(sums[0] - sums[1]) < 1e-6
        assert abs(r.score - 1 / sum(math.exp(max(x - top, -700)) for x in sums)) < 1e-6


def test_sample_bound_at_any_size():
    """The share drawn is limit of n rows, also of very many."""
    for limit, n in ((12_000, 12_000), (12_000, 24_001), (24_000, 30_000_000_000), (12_000, 10**15)):
        share = (quality.bound(limit, n) + (1 << 63)) / 2**64
        assert abs(share - min(1, limit / n)) <= 1e-9 * min(1, limit / n) + 2**-64
    assert quality.bound(5, 0) == (1 << 63) - 1


def test_risk_and_gradient_by_differences():
    """The step of training against numerical differences of the non-negative risk, on both sides of its bend."""
    rng = np.random.default_rng(2)
    xp, xu = rng.normal(0.5, 1, (40, 6)), rng.normal(0, 1, (50, 6))
    weights = [rng.normal(0, 0.5, (6, 3)), rng.normal(0, 0.5, 3), rng.normal(0, 0.5, 9), np.array(0.1)]
    for prior in (0.1, 0.9):
        model = quality.Model(np.zeros(6), np.ones(6), [w.copy() for w in weights])

        def logit(x):
            h = np.concatenate([x, np.tanh(x @ model.weights[0] + model.weights[1])], 1)
            return h @ model.weights[2] + model.weights[3]

        def parts():
            p, u = logit(xp), logit(xu)
            return prior * np.log1p(np.exp(-p)).mean(), np.log1p(np.exp(u)).mean() - prior * np.log1p(np.exp(p)).mean()

        good, bad = parts()
        risk, grads = quality.step(model, xp, xu, prior)
        assert abs(risk - bad) < 1e-9
        # where the negative part is below zero, the step goes back up on it alone
        goal = (lambda: sum(parts())) if bad >= 0 else (lambda: -parts()[1])
        for w, g in zip(model.weights, grads, strict=True):
            flat = w.reshape(-1)
            for k in range(0, flat.size, 5):
                kept, flat[k] = flat[k], flat[k] + 1e-6
                up = goal()
                flat[k] = kept - 1e-6
                down = goal()
                flat[k] = kept
                assert abs((up - down) / 2e-6 - np.asarray(g).reshape(-1)[k]) < 1e-5


@pytest.fixture(scope="module")
def codec():
    return S.Codec(open(S.MODEL, "rb").read())


def test_codec_equals_the_model_without_dropout(codec, odd):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=S.MODEL)
    texts = [t for _, t in odd if t is not None and "▁" not in t] + ["   a  b ", "\n\n x\ty", "naïve\x00", "    def f():\n        return  x"]
    for t, b in zip(texts, codec.encode(texts, [0] * len(texts), {}, 0, 0.0), strict=True):
        assert np.frombuffer(b, np.int32).tolist() == sp.encode(t)


def test_codec_dropout(codec, odd):
    texts = [t or "" for _, t in odd]
    one, same, other = (codec.encode(texts, [0] * len(texts), {}, seed, 0.2) for seed in (1, 1, 2))
    assert one == same and one != other
    alone = [codec.encode([t], [0], {}, 1, 0.2)[0] for t in texts]  # no batch changes a result
    assert alone == one
    for t, b in zip(texts, other, strict=True):
        assert codec.decode(np.frombuffer(b, np.int32)) == t.encode()
    whole = codec.encode(texts, [0] * len(texts), {}, 1, 1.0)
    assert sum(map(len, whole)) > sum(map(len, one)) > sum(map(len, codec.encode(texts, [0] * len(texts), {}, 1, 0.0)))


def test_long_units_have_the_same_agenda(codec, odd, monkeypatch):
    texts = [t or "" for _, t in odd] + ["antidisestablishmentarianism" * 30, "z" * 5000]
    want = [codec.encode(texts, [0] * len(texts), {}, 3, rate) for rate in (0.0, 0.3)]
    monkeypatch.setattr(S, "LONG", 3)
    assert [codec.encode(texts, [0] * len(texts), {}, 3, rate) for rate in (0.0, 0.3)] == want


def test_codec_table(spark, documents, nothing):
    out = S.encoded(documents).cache()
    assert out.count() == documents.count() and out.where("NOT lossless").count() == 0
    back = S.decoded(out).join(documents.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id")
    assert back.where("NOT text <=> t").count() == 0
    assert out.where("doc_id = 0 AND ids IS NULL").count() == 1 and S.encoded(nothing).count() == 0


def test_dropout_is_drawn_for_each_occurrence(codec):
    """A word's segmentations grow with its occurrences, within a document and over documents, and keeping results changes none."""
    texts = ["internationalization " * 40, "misunderstanding ▁x \n" * 20]
    out = [np.frombuffer(b, np.int32).tolist() for b in codec.encode(["internationalization"] * 400, list(range(400)), {}, 1, 0.2)]
    assert len({tuple(x) for x in out}) > 8
    kept = {}
    first, second = codec.encode(texts * 2, [5, 5, 6, 6], kept, 1, 0.2)[::2]
    assert first != second
    assert len({codec.decode(np.frombuffer(b, np.int32)) for b in (first, second)}) == 1
    with pytest.MonkeyPatch.context() as m:
        m.setattr(S, "SHORT", 0)  # no trees
        plain = codec.encode(texts * 2, [5, 5, 6, 6], {}, 1, 0.2)
    assert codec.encode(texts * 2, [5, 5, 6, 6], kept, 1, 0.2) == plain


def test_dropout_equals_a_plain_agenda(codec, odd):
    """Whole texts against a loop that asks all pairs anew at each step, with draws of its own arithmetic."""
    mask = (1 << 64) - 1

    def mixed(h):
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask
        return h ^ h >> 32

    def plain(text, doc, seed, rate):
        out = []
        for place, unit in enumerate(codec.unit.findall(" " + text) if text else []):
            key = mixed(mixed(doc % 2**64 ^ mixed(place + 1)) + seed * 0x9E3779B97F4A7C15 & mask)
            parts = [(k, k + 1, codec.usable.get("▁" if c == " " else c) if c != "▁" else None, c) for k, c in enumerate(unit)]
            while True:
                best = None
                for k in range(len(parts) - 1):
                    (a, m, left, _), (_, b, right, _) = parts[k], parts[k + 1]
                    found = codec.merges.get(left * codec.size + right) if left is not None and right is not None else None
                    if found and mixed(key ^ mixed((a << 40) + (m << 20) + b + 1)) >= int(rate * 2.0**64) and (best is None or found[0] < best[0]):
                        best = found[0], k, (a, b, found[1], "")
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [best[2]]
            for _, _, piece, c in parts:
                out += [piece] if piece is not None else [codec.bytes[x] for x in c.encode()]
        return out

    texts = [t[:600] for _, t in odd if t]
    kept = {}
    for _ in range(3):  # agendas in numpy at first, trees later
        got = codec.encode(texts, list(range(-3, len(texts) - 3)), kept, 4, 0.25)
    for k, (t, b) in enumerate(zip(texts, got, strict=True)):
        assert np.frombuffer(b, np.int32).tolist() == plain(t, k - 3, 4, 0.25)
