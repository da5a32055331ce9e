import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, _id string, score string, predicted string, found string"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}{'éß日'[rng.randrange(3)] if rng.random() < 0.1 else ''}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd():
    """Texts of all kinds: null, empty, blank, short, very long, repeated within and across documents, exact and near copies, ties."""
    import random

    rng = random.Random(5)
    base, passage = words(rng, 160), words(rng, 60)
    near = [list(base) for _ in range(6)]
    for k, w in enumerate(near):
        for _ in range(k):
            w[rng.randrange(len(w))] = f"edit{k}"
    texts = [None, "", " \t\n ", "one", "One two three", "x " * 300, "a\x0bb\x0cc\rd\x1ce f"]
    texts += [" ".join(base)] * 3 + [" ".join(w) for w in near]
    texts += [" ".join(words(rng, 40) + passage + words(rng, 30)) for _ in range(5)] + [" ".join(passage[:20]), " ".join(passage[:19]), " ".join(passage * 2)]
    texts += ["\n".join(words(rng, 200)), "z" * 400, "日本語" * 90, "🤗 ▁ é" * 40, " ".join(words(rng, 30_000))]
    texts += [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(20)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def documents(spark, odd):
    """The odd texts with columns whose names clash with the operators' own, one row given twice, and a null doc_id."""
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t), "b", "i", "s", "p", "f") for i, t in odd]
    rows.append(rows[7])
    rows.append((None, "no key at all", None, None, None, "b", "i", "s", "p", "f"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
