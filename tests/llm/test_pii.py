"""Personal data: every text against plain regular expressions, added kinds against cases, and hostile texts."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from cadenza.llm import pii

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def right(kind, what):
    digits = re.sub("[^0-9]", "", what)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in what.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def base(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(PLAIN) for m in p.finditer(text or "") if right(kind, m.group())]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    return {r.doc_id: r.pii for r in pii.personal_data(df).collect()}


def numbers(rng, n):
    """Texts of pieces that come close to matches, so that all edges are met."""
    pieces = ["4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "255.1.2.3", "256.1.2.3", "00010.1.1.1", "1.2.3", "a@b.c_d@e.f", "x@y", "@", ".", "+", "-", " ", "  ", "9", "12", "é日", "🤗", "\n", "(", ")", "%", "a.b@c-d.e.f-", "0000000000000000", "+49 30 1234567", "call", "ssn"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_base_spans_equal_plain_expressions(spark, odd):
    texts = [t for _, t in odd] + numbers(random.Random(11), 600) + ["z" * 100 + " 4111111111111111 " * 300]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == base(t), t
        keys = [(s.start, pii.KINDS.index(s.kind), s.end) for s in got[i]]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)


ADDED = {
    "IBAN GB82 WEST 1234 5698 7654 32 please": ["iban"],
    "DE89370400440532013000": ["iban"],
    "DE88370400440532013000": [],
    "xDE89370400440532013000": [],
    "my ssn is 078-05-1120": ["ssn"],
    "article 078-05-1120": [],
    "ssn 000-05-1120": [],
    "ssn 078-05-0000\n": [],
    "call (487) 555-7209 now": ["phone"],
    "number (487) 555-7209 now": [],
    "order call 487-555-7209": [],
    "4111111111111111 4111111111111111": ["card", "card"],
    "4111111111111111" * 2: [],
    "1 \n4111111111111111": [],
    "order 4111111111111111 1": [],
    "visa 4222222222222 x": ["card"],
    "4222222222222 x": [],
    None: [],
    "": [],
}


def test_added_spans(spark):
    got = found(spark, list(ADDED))
    for i, (text, kinds) in enumerate(ADDED.items()):
        assert [s.kind for s in got[i] if not s.base] == kinds, text


def test_context_moves_the_score_but_not_base_spans(spark):
    got = found(spark, ["card 4111111111111111", "invoice 4111111111111111", "4111111111111111"])
    assert [(s.score, s.base) for k in range(3) for s in got[k]] == [(105, True), (45, True), (80, True)]


def test_no_text_is_slow(spark):
    texts = ["a" * 300_000, "7" * 300_000, "+" * 100_000, "+1" + "(" * 200_000, "1." * 150_000, "a@" * 100_000, "a@" + "b." * 150_000, "4111111111111111, " * 20_000, "1 " * 150_000, "A1" * 150_000]
    began = time.time()
    got = found(spark, texts)
    assert time.time() - began < 60
    assert len(got[7]) == 20_000 and [(s.start, s.end) for s in got[6]] == [(0, 300_001)]


def test_query_and_empty_table(spark, documents, nothing, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op11_pii(spark, str(tmp_path)).collect()
    assert len(rows) == documents.count()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone")]
    assert pii.personal_data(nothing).count() == 0 and "pii" in pii.personal_data(nothing).columns


def test_no_python_in_the_plan(spark):
    plan = pii.op11_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and plan.count("split(") <= 10


def test_blocks_of_sums(spark):
    for n in (0, 1, 2, 3, 10, 101):
        got = spark.range(1).select(pii.before_each(F.expr(f"transform(slice(sequence(1, 200), 1, {n}), x -> cast(x as bigint))")).alias("x")).first().x
        assert got == [k * (k + 1) // 2 for k in range(n)]
