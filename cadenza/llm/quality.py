"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network under the non-negative
risk of Kiryo et al. (2017): ``prior * R+(1) + max(0, R_u(0) - prior * R+(0))``. The class prior
is not given; it is estimated from how the two samples fill the scores' top bins (Garg et
al. 2021). Negative labels are never used. The samples are bounded
(``MAX_POSITIVE``, ``MAX_UNLABELLED``, chosen by a hash of doc_id) and the features of those rows alone come
to the driver; scoring runs over whole texts in tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import exchange as X
from cadenza.llm.kernels import slices, text_bytes, word_hashes, words

MAX_POSITIVE, MAX_UNLABELLED, CUT = 12_000, 24_000, 0.3
CLASSES = 14
_CLASS = np.full(256, 13, np.int64)  # bytes of other scripts and accents
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "|", "#$%&*@", "<>/\\=_{}[]~^", "\t\r\x0b\x0c", "\"'():;-`+")):
    _CLASS[list(_chars.encode())] = _k
_CLASS[:9] = _CLASS[14:32] = 11
EXTRA = 12
WIDTH = CLASSES + CLASSES * CLASSES + EXTRA


def features(column: pa.Array) -> np.ndarray:
    """One row of floats per text: shares of byte classes and of their pairs, and of repeated words, lines and shapes of words."""
    data, offsets = text_bytes(column)
    n, rows = np.diff(offsets), len(offsets) - 1
    out = np.zeros((rows, WIDTH))
    doc = np.repeat(np.arange(rows), n)
    code = _CLASS[data]
    size = np.maximum(n, 1)[:, None]
    out[:, :CLASSES] = np.bincount(doc * CLASSES + code, minlength=rows * CLASSES).reshape(rows, -1) / size
    same = doc[1:] == doc[:-1]
    pair = (doc[1:] * CLASSES + code[:-1]) * CLASSES + code[1:]
    out[:, CLASSES : CLASSES + CLASSES**2] = np.bincount(pair[same], minlength=rows * CLASSES**2).reshape(rows, -1) / size
    starts, ends, first = words(data, offsets)
    w = np.diff(first)
    count = np.maximum(w, 1)
    x = out[:, -EXTRA:]
    if len(starts):
        h = word_hashes(data, starts, ends, lower=True)
        owner = np.repeat(np.arange(rows), w)
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])
        order = np.lexsort((h, owner))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
        length = ends - starts
        upper = (code[starts] == 1) & (code[ends - 1] != 0) & (length > 1)
        tail = code[ends - 1]
        shape = (again, new[np.argsort(order)], length, length > 12, upper, code[starts] == 1, tail == 5, tail == 6, tail == 7, tail >= 8)
        for k, values in enumerate(shape):
            x[:, k] = np.bincount(owner, values, rows) / count
        x[:, 2] /= 16
    x[:, -2] = np.log1p(w) / 10
    x[:, -1] = np.log1p(n / np.maximum(np.bincount(doc[code == 4], minlength=rows) + 1, 1)) / 10
    return out


class Model:
    """A network with one hidden layer over standardised features."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def hidden(self, x):
        a, b, _, _ = self.weights
        return np.tanh(x @ a + b)

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        h = np.concatenate([x, self.hidden(x)], 1)
        return 1 / (1 + np.exp(-np.clip(h @ self.weights[2] + self.weights[3], -30, 30)))


def _moments(*samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the rows of all samples, without a copy of them."""
    parts = [x[k : k + 4096] for x in samples for k in range(0, len(x), 4096)]
    n = sum(map(len, parts))
    mean = sum(x.sum(0, dtype=np.float64) for x in parts) / n
    return mean, np.sqrt(sum(((x - mean) ** 2).sum(0) for x in parts) / n)


def _gradient(model: Model, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
    hid = model.hidden(x)
    h = np.concatenate([x, hid], 1)
    back = slope[:, None] * model.weights[2][x.shape[1] :] * (1 - hid**2)
    return [x.T @ back, back.sum(0), h.T @ slope, np.array(slope.sum())]


def step(model: Model, pos: np.ndarray, unl: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """The negative part of the risk over two samples, and the gradient of what a step of training lowers.

    Logistic loss: as negative -log(1 - s), slope s; as positive -log s, slope s - 1. The negative part must not fall
    below zero: where it has, it is stepped back. prior None: positives against unlabelled rows, as an ordinary classifier.
    """
    sp, su = (1 / (1 + np.exp(-np.clip(np.concatenate([x, model.hidden(x)], 1) @ model.weights[2] + model.weights[3], -30, 30))) for x in (pos, unl))
    n, m = len(pos), len(unl)
    risk = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + (prior or 0) * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
    if prior is None:
        slopes = (sp - 1) / n, su / m
    elif risk >= 0:
        slopes = prior * ((sp - 1) - sp) / n, su / m
    else:
        slopes = prior * sp / n, -su / m
    return float(risk), [a + b for a, b in zip(_gradient(model, pos, slopes[0]), _gradient(model, unl, slopes[1]), strict=True)]


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, seed: int, width: int = 16) -> Model:
    """Adam over random batches of both samples, at a falling rate, with a small decay of weights."""
    rng = np.random.default_rng(seed)
    mean, scale = _moments(pos, unl)
    scale += 1e-3
    k = pos.shape[1]
    model = Model(mean, scale, [rng.normal(0, k**-0.5, (k, width)), np.zeros(width), np.zeros(k + width), np.array(0.0)])
    first, second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for t in range(1, steps + 1):
        xp, xu = (np.clip((x[rng.integers(0, len(x), 512)] - mean) / scale, -8, 8) for x in (pos, unl))
        _, grads = step(model, xp, xu, prior)
        rate = 0.01 * (1 - t / (steps + 1))
        for i, g in enumerate(grads):
            g = g + 1e-4 * model.weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            model.weights[i] = model.weights[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    return model


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 0) -> float:
    """The share of positives among unlabelled rows: the least ratio of the two samples' tails, with a confidence margin."""
    a, b = pos[::2], unl[::2]
    held_p, held_u = pos[1::2], unl[1::2]
    if not (len(a) and len(b) and len(held_p) and len(held_u)):
        return 0.5
    model = _train(a, b, None, 400, seed)
    p, u = (np.sort(np.concatenate([model.scores(x[k : k + 4096]) for k in range(0, len(x), 4096)])) for x in (held_p, held_u))
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    tail_p = 1 - np.searchsorted(p, cuts) / len(p)
    tail_u = 1 - np.searchsorted(u, cuts) / len(u)
    margin = np.sqrt(np.log(20) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((tail_u + margin) / np.maximum(tail_p, 1e-9))
    share = min(1.0, tail_u[best] / tail_p[best])
    # imperfect scores of small samples only raise the ratio, so the lower bound is the better guess
    error = np.sqrt(share * (1 - share) * (1 / len(p) + 1 / len(u)))
    return float(np.clip(share - 1.25 * error, 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1200, seed: int = 0) -> Model:
    """Rows of features; without positives or unlabelled rows the model scores every text alike."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), [np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(WIDTH + 1), np.array(0.0)])
    return _train(positive, unlabelled, class_prior(positive, unlabelled, seed), steps, seed)


def bound(limit: int, n: int) -> int:
    """The 64-bit hash up to which a row is drawn, so that about limit of n rows are, however many there are."""
    return (1 << 63) - 1 if n <= limit else (limit << 64) // n - (1 << 63)


def sample(documents: DataFrame, wanted: DataFrame, limit: int) -> np.ndarray:
    """Features of at most about limit documents among wanted doc_ids (all documents if None), least hashes first."""
    ids = documents.select("doc_id") if wanted is None else wanted.select("doc_id").distinct()
    n = ids.count()
    chance = F.xxhash64("doc_id", F.lit(17)) <= bound(limit, n)
    rows = documents.select("doc_id", "text").where(chance)
    if wanted is not None:
        rows = rows.join(ids.where(chance), "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text")).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x binary").toArrow()
    if limit < n and not got.num_rows:
        raise ValueError("no row was drawn for the sample")
    got = got.sort_by([("doc_id", "ascending"), ("x", "ascending")]).column("x").combine_chunks()
    return text_bytes(got)[0].view(np.float32).reshape(-1, WIDTH)


def scored(documents: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """keep's columns of documents, then score and prediction under these names. A null text is scored as an empty one."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = sent.value.scores(features(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, {names[0]} double, {names[1]} int")


def learned(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from positives and unlabelled rows whose crc32(doc_id) mod 5 is not 0."""
    open_ = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    good = labels.where(open_).where("quality = 1")
    return fit(sample(documents, good, MAX_POSITIVE), sample(documents.where(open_), None, MAX_UNLABELLED))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
