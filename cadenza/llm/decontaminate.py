"""Short test items inside long documents, by size-partitioned MinHash containment search.

Items are partitioned by size (powers of two). An item's sketch is its ``s`` least
shingle hashes (a bottom-s MinHash), with ``s`` set by its size so that a document that holds the
threshold's share of the item's shingles must hold one of them: with at most ``m - ceil(t * m)``
of ``m`` shingles missing, one more than that cannot all be missing. Sketches are
probed with every shingle of every document, of any length, in one pass; hits are
verified by exact containment of the item's whole shingle set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import exchange as X
from cadenza.llm.kernels import sequences, slices, text_bytes, word_hashes, words

BLOCK_BYTES = 32 << 20  # of item texts that are broadcast; larger benchmarks are joined
FILTER_BITS = 26  # of a bit table that says which sketches there may be, where they are joined


def item_sets(texts: list[str | None], size: int):
    """(row, shingle length, sorted distinct hashes) of each text that has words."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = words(data, offsets)
    made = sequences(word_hashes(data, starts, ends, lower=True), *range(1, size + 1))
    for row, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if e > s:
            k = min(size, e - s)
            yield row, k, np.unique(made[k - 1][s : e - k + 1])


def sketch(own: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a set, one more than a document that holds percent of it can lack."""
    return own[: len(own) + percent * len(own) // -100 + 1]


def grams(text: str, k: int) -> set[bytes]:
    own = _lowered(text).split()
    return {b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)}


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only


class Index:
    """Sketches, full shingle sets and texts of a block of items, by shingle length and size partition."""

    def __init__(self, ids: list[int], texts: list[str], size: int, percent: int):
        self.ids, self.texts, self.percent = ids, texts, percent
        self.sets: dict[int, tuple[int, np.ndarray]] = {}
        sketches: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for row, k, own in item_sets(texts, size):
            self.sets[row] = k, own
            sketches.setdefault((k, len(own).bit_length()), []).append((sketch(own, percent), row))
        self.parts = []
        for (k, _), members in sorted(sketches.items()):
            prints = np.concatenate([p for p, _ in members])
            rows = np.repeat([r for _, r in members], [len(p) for p, _ in members])
            order = np.argsort(prints, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[prints >> np.uint64(44)] = True
            self.parts.append((k, prints[order], rows[order], seen))
        self.lengths = sorted({k for k, _ in self.sets.values()})

    def search(self, column: pa.Array):
        """(row, item row, item's shingles, shared ones) of a slice of documents: found by hashes, then verified on the shingles themselves."""
        data, offsets = text_bytes(column)
        starts, ends, first = words(data, offsets)
        made = dict(zip(self.lengths, sequences(word_hashes(data, starts, ends, lower=True), *self.lengths), strict=True)) if self.lengths else {}
        found: set[tuple[int, int]] = set()
        for k, prints, rows, seen in self.parts:
            at = np.flatnonzero(seen[made[k] >> np.uint64(44)])
            if not len(at):
                continue
            at = at[np.isin(made[k][at], prints)]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[doc + 1]
            at, doc = at[inside], doc[inside]
            lo, hi = np.searchsorted(prints, made[k][at]), np.searchsorted(prints, made[k][at], "right")
            for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
                found.update((d, int(r)) for r in rows[a:b])
        own: dict[tuple[int, int], np.ndarray] = {}
        real: dict[tuple[int, int], set[bytes]] = {}
        for d, r in sorted(found):
            k, item = self.sets[r]
            if (d, k) not in own:
                own = {(d, k): np.unique(made[k][first[d] : first[d + 1] - k + 1])} | {x: y for x, y in own.items() if x[0] == d}
            if 100 * int(np.isin(item, own[d, k]).sum()) < self.percent * len(item):
                continue
            if (d, k) not in real:
                real = {(d, k): grams(column[d].as_py(), k)} | {x: y for x, y in real.items() if x[0] == d}
            said = grams(self.texts[r], k)
            n = len(said & real[d, k])
            if 100 * n >= self.percent * len(said):
                yield d, r, len(said), n


def contained(documents: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (_doc, _id, _th, item_id, n_item, n_shared): the document holds at least percent of the item's distinct shingles.

    ``_doc`` is the doc_id, and ``_id, _th`` the row's key (see ``exchange.keyed``). Words are split at ASCII white space, A-Z in lower case. An item with fewer
    words than a shingle is one shingle; an item or a document without text or words
    meets nothing. Items that repeat an item_id and text count once; repeated documents each
    give rows; other columns are ignored. Documents are read once: items of up to block_bytes of text are broadcast,
    and beyond that their sketches are joined.
    """
    texts = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    docs = X.keyed(documents)
    kind = docs.schema["_doc"].dataType.simpleString()
    columns = f"_doc {kind}, _id long, _th long, item_id long, n_item long, n_shared long"
    names = ["_doc", "_id", "_th", "item_id", "n_item", "n_shared"]
    if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return _joined(docs, texts, size, percent, columns)
    rows = texts.orderBy("item_id", "text").collect()
    sent = documents.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], size, percent))

    def run(batches):
        index = sent.value
        for batch in batches:
            for part in slices(batch):
                hits = [(d, index.ids[r], n, m) for d, r, n, m in index.search(part.column("text"))]
                if hits:
                    d, *rest = (list(x) for x in zip(*hits, strict=True))
                    own = part.take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names[:3]), *(pa.array(x, pa.int64()) for x in rest)], names=names)

    return docs.mapInArrow(run, columns)


def _joined(docs: DataFrame, texts: DataFrame, size: int, percent: int, columns: str) -> DataFrame:
    """contained for items of any number: sketches meet the documents' shingles by a join, behind a bit table of fixed size."""
    items = X.written(texts.withColumn("_item", F.sha2(F.concat_ws(":", "item_id", "text"), 256)), "items")

    def sketched(batches):
        for batch in batches:
            for part in slices(batch):
                names = part.column("_item").to_pylist()
                for row, k, own in item_sets(part.column("text").to_pylist(), size):
                    prints = sketch(own, percent).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([names[row]] * len(prints)), pa.array(np.full(len(prints), k, np.int32)), pa.array(prints)], names=["_item", "k", "print"])

    sketches = X.written(items.mapInArrow(sketched, "_item string, k int, print long"), "sketches")
    place = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    table = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for word, bits in sketches.select(F.shiftrightunsigned(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - FILTER_BITS}) & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b")).toLocalIterator():
        table[word] = bits
    seen = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))
    lengths = sorted(r.k for r in sketches.select("k").distinct().collect())

    def probed(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, first = words(data, offsets)
                for k, made in zip(lengths, sequences(word_hashes(data, starts, ends, lower=True), *lengths), strict=True):
                    spot = made >> np.uint64(64 - FILTER_BITS)
                    at = np.flatnonzero(seen.value[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1))
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + k <= first[doc + 1]
                    own = part.take(pa.array(doc[inside]))
                    yield pa.RecordBatch.from_arrays([own.column("_id"), own.column("_th"), pa.array(np.full(inside.sum(), k, np.int32)), pa.array(made[at[inside]].view(np.int64))], names=["_id", "_th", "k", "print"])

    probes = docs.select("_id", "_th", "text").mapInArrow(probed, "_id long, _th long, k int, print long").distinct()
    pairs = X.written(probes.join(sketches, ["k", "print"]).select("_id", "_th", "_item").distinct(), "pairs")

    def verified(batches):
        for batch in batches:
            hits = []
            for row, (text, item) in enumerate(zip(batch.column("text").to_pylist(), batch.column("item").to_pylist(), strict=True)):
                k = min(size, len(_lowered(item).split()))
                said = grams(item, k)
                n = len(said & grams(text, k))
                if 100 * n >= percent * len(said):
                    hits.append((row, len(said), n))
            if hits:
                row, *rest = (list(x) for x in zip(*hits, strict=True))
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("_doc", "_id", "_th", "item_id")), *(pa.array(x, pa.int64()) for x in rest)], names=["_doc", "_id", "_th", "item_id", "n_item", "n_shared"])

    whole = docs.join(pairs, ["_id", "_th"]).join(items.select("_item", "item_id", F.col("text").alias("item")), "_item")
    return whole.select("_doc", "_id", "_th", "text", "item_id", "item").mapInArrow(verified, columns)


def without_leaks(documents: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows that hold under percent of every item's shingles, with all their columns.

    A row goes for its own text: others that share its doc_id, or have none either, stay. Rows without a text stay.
    """
    leaks = X.written(contained(documents, items, size, percent).select("_id", "_th").distinct(), "leaks")
    rows = X.keyed(documents, whole=True).join(leaks, ["_id", "_th"], "left_anti")
    return X.unkeyed(rows, documents)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("_doc").alias("doc_id"), "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


OP5_SQL = r"""
WITH words AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
lengths AS (SELECT DISTINCT least(len(ws), 5) AS k FROM words WHERE kind = 'i' AND len(ws) > 0),
grams AS (
  SELECT DISTINCT kind, id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT kind, id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i
        FROM words, lengths WHERE len(ws) >= k AND (kind = 'd' OR k = least(len(ws), 5)))),
sizes AS (SELECT id, k, count(*) AS n FROM grams WHERE kind = 'i' GROUP BY id, k),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, i.k, count(*) AS c
  FROM grams i JOIN grams d ON i.kind = 'i' AND d.kind = 'd' AND i.g = d.g AND i.k = d.k GROUP BY 1, 2, 3)
SELECT doc_id, item_id, n::BIGINT AS n_item, c::BIGINT AS n_shared, c / n AS containment
FROM shared s JOIN sizes z ON s.item_id = z.id AND s.k = z.k WHERE 100 * c >= 80 * n
"""
