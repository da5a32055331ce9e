"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass that leaves (language, bucket, count) rows to Spark's own
aggregation; the matrix of log-probabilities is broadcast. It has ``2**BITS`` buckets for each language up to ``MANY``
languages, and half as many whenever these double (256 at least), so that its size stays the same. Scoring gathers and sums its rows per document in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.kernels import mix, slices

BITS, SIZES, MANY = 15, (1, 2, 3), 256
_BLANK = np.ones(0x250, bool)
_BLANK[[c for c in range(0x250) if chr(c).isalpha()]] = False


def width(languages: int) -> int:
    """Bits of a bucket's number."""
    return max(8, BITS - max(0, (languages - 1) // MANY).bit_length())


def grams(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-case code points, row by row; what is no letter counts as a blank."""
    lower = [(t or "").lower() for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in lower])]).astype(np.int64)
    low = code < 0x250
    code[low] = np.where(_BLANK[code[low]], np.uint64(32), code[low])
    doc_end = np.repeat(begin[1:], np.diff(begin))
    found, where = [], []
    h = np.zeros(len(code), np.uint64)
    at = np.arange(len(code))
    for n in range(1, max(SIZES) + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        if n in SIZES:
            ok = at[: len(h)] + n <= doc_end[: len(h)]
            found.append((mix(h[ok].copy()) >> np.uint64(64 - bits)).astype(np.int64))
            where.append(at[: len(h)][ok])
    # n-grams of one size follow the text's order, so each size has its own bounds
    return found, [np.searchsorted(w, begin) for w in where]


def counted(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, bucket, count) of rows (text, lang)."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").to_pylist()
                found, bounds = grams(part.column("text").to_pylist(), bits)
                names = sorted(set(langs))
                code = np.searchsorted(names, langs)
                for f, b in zip(found, bounds, strict=True):
                    tally = np.bincount(f + (np.repeat(code, np.diff(b)) << bits), minlength=len(names) << bits).reshape(len(names), -1)
                    for x, t in zip(names, tally, strict=True):
                        total[x] = total[x] + t if x in total else t
        for x, t in sorted(total.items()):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(t[at], pa.int64())], names=["lang", "bucket", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix (bucket, language) of log-probabilities, from every row with a language and a text."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    bits, number = width(len(names)), {x: k for k, x in enumerate(names)}
    matrix = np.full((1 << bits, len(names)), smoothing)
    for lang, bucket, n in counted(rows, bits).toLocalIterator():
        matrix[bucket, number[lang]] += n
    return names, np.log(matrix / matrix.sum(0)) if names else matrix


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns of documents (or those of keep), then ``lang_pred`` and ``score`` (the posterior under equal priors).

    A null text, one without letters, or any text under a model of no language is ``und`` with score 0.
    """
    names, matrix = model
    sent = documents.sparkSession.sparkContext.broadcast(matrix)
    keep = [c for c in keep or documents.columns if c not in ("lang_pred", "score")]

    def run(batches):
        m = sent.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                total = np.zeros((len(texts), m.shape[1]))
                if names:
                    for f, b in zip(*grams(texts, m.shape[0].bit_length() - 1), strict=True):
                        some = np.flatnonzero(np.diff(b))
                        if len(some):
                            for k in range(len(names)):
                                total[some, k] += np.add.reduceat(m[f, k], b[some])
                letters = np.array([any(map(str.isalpha, t or "")) for t in texts]) & bool(names)
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if letters.any():
                    best = total.argmax(1)
                    top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    pred[letters], score[letters] = np.array(names, object)[best[letters]], top[letters]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held).select("text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
