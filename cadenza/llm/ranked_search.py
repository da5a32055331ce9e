r"""Ranked lexical search: an inverted index in shards of documents, searched by MaxScore.

A shard holds the documents that one task reads together (about 2 MB of text, a larger text alone): for each term its postings (document, occurrences), with the
largest occurrence count and the least document length among them, from which its highest possible contribution follows whatever the collection's statistics turn
out to be. Shards are rows of a table; counts of documents, terms and documents that hold a term are sums over it.

For an item, a shard's terms are sorted by their highest contribution. As long as the contributions of the first ones together stay below the score that a document
must reach, these are non-essential: a document that holds no other term can't qualify. Documents come from the postings of the essential terms alone; the
others' postings are probed, from the highest contribution down, only for documents that may still qualify. The score to reach is the lowest of
the best documents that the task has found so far, over all its shards, so it rises along the way; equal scores still qualify, as the
smaller doc_id wins. Only the best of each task leave it, and a window ranks them.

Terms are compared as strings, not as hashes. Items are searched in blocks of ``ITEM_BYTES`` of text, each of which goes to all tasks.

A shard is a row of megabytes, so rows are handed on few at a time: the index has small row groups, and its readers get batches of ``BATCH_BYTES``. What a
task holds is then a few shards, however many its share of the index has.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import exchange as X
from cadenza.llm.kernels import pack, slices, text_bytes, unpack, words

# Bytes that lie between terms (all of ASCII but digits and letters), and small letters for A-Z.
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SCALE, FREE, LENGTH = 1_000_000_000, 75, 25  # of a contribution; the length's part and the rest, of 100
ITEM_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
PARTS = ("ids", "lengths", "terms", "widths", "sizes", "most", "least", "docs", "counts")  # of a shard, a packed array each
SHARD = ", ".join(f"{x} binary" for x in PARTS)
ARROW_SHARD = pa.schema([(x, pa.binary()) for x in PARTS])
FOUND = "item int, id long, score long"


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows, end to end, and the row of each; only A-Z is lower-cased."""
    data, offsets = text_bytes(column)
    starts, ends, first = words(data, offsets, BREAK)
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(ends - starts))), pa.py_buffer(LOWER[data[~BREAK[data]]])])
    return terms, np.repeat(np.arange(len(column)), np.diff(first))


def shard(batch: pa.RecordBatch) -> dict:
    terms, row = terms_of(batch.column("text"))
    coded = terms.dictionary_encode()
    n = len(batch)
    keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * n + row, return_counts=True)
    term, doc = keys // n, keys % n
    lengths = np.bincount(row, minlength=n)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    reduced = lambda f, x: f.reduceat(x, first) if len(first) else x[:0]
    sizes = np.diff(np.append(first, len(term)))
    steps = np.diff(doc, prepend=0)
    steps[first] = doc[first]
    return {
        "ids": pack(batch.column("_id").to_numpy(zero_copy_only=False)),
        "lengths": pack(lengths.astype(np.int64)),
        "terms": b"".join(coded.dictionary.cast(pa.binary()).to_pylist()),
        "widths": pack(pc.binary_length(coded.dictionary).to_numpy().astype(np.uint32)),
        "sizes": pack(sizes.astype(np.uint32)),
        "most": pack(reduced(np.maximum, counts).astype(np.uint32)),
        "least": pack(reduced(np.minimum, lengths[doc]).astype(np.uint32)),
        "docs": pack(steps.astype(np.uint32)),
        "counts": pack(counts.astype(np.uint32)),
    }


def strings(data: bytes, widths: bytes) -> pa.Array:
    """A shard's terms."""
    ends = np.cumsum(np.append(0, unpack(widths, np.uint32).astype(np.int64)))
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def places(asked: pa.Array, data: bytes, widths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which asked words a shard has, and where."""
    at = pc.index_in(asked, strings(data, widths))
    has = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return has, at.fill_null(0).to_numpy()[has].astype(np.int64)


def index(documents: DataFrame) -> DataFrame:
    """The shards of documents (doc_id, text). Null and empty texts have no terms; a null doc_id counts as the least; rows that repeat are documents of their own."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pylist([shard(part)], schema=ARROW_SHARD)

    return X.keyed(documents).select("_id", "text").mapInArrow(run, SHARD)


def stored(documents: DataFrame) -> DataFrame:
    """The index as a table."""
    with X.setting(documents.sparkSession, X.BATCH, str(BATCH_BYTES)):
        return X.written(index(documents), "shards", **X.LARGE_ROWS)


def statistics(shards: DataFrame, asked_words: list[str]) -> tuple[int, int, DataFrame]:
    """Documents with terms, all terms, and (word, df) of the words."""

    def sizes(batches):
        for batch in batches:
            lengths = [unpack(x, np.int64) for x in batch.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_pydict({"documents": pa.array([sum(int((x > 0).sum()) for x in lengths)]), "terms": pa.array([sum(int(x.sum()) for x in lengths)])})

    def holding(batches):
        asked, total = pa.array(asked_words, pa.large_string()), np.zeros(len(asked_words), np.int64)
        for batch in batches:
            for data, widths, sizes in zip(*(batch.column(c).to_pylist() for c in ("terms", "widths", "sizes")), strict=True):
                has, at = places(asked, data, widths)
                total[has] += unpack(sizes, np.uint32)[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(some, pa.int32()), "df": pa.array(total[some])})

    both = shards.select("lengths").mapInArrow(sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    held = shards.select("terms", "widths", "sizes").mapInArrow(holding, "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    return both[0] or 0, both[1] or 0, held


def weights(held: DataFrame, n: int) -> dict[int, int]:
    weight = F.floor(1000 * F.log((F.lit(2.0 * n + 2)) / (2.0 * F.col("df") + 1)))
    return {r.word: r.weight for r in held.select("word", weight.alias("weight")).collect()}


class Shard:
    """One shard's postings of the asked words."""

    def __init__(self, row: dict, asked: pa.Array, n: int, total: int):
        self.ids, lengths = unpack(row["ids"], np.int64), unpack(row["lengths"], np.int64)
        if 25 * n * int(lengths.max(initial=0)) >= 1 << 63:
            self.m = np.array([FREE + 25 * int(x) * n // total for x in lengths], np.int64)
        else:
            self.m = FREE + 25 * lengths * n // max(1, total)
        has, at = places(asked, row["terms"], row["widths"])
        ends = np.cumsum(unpack(row["sizes"], np.uint32), dtype=np.int64)
        self.begin, self.end = ends - unpack(row["sizes"], np.uint32), ends
        self.at = dict(zip(has.tolist(), at.tolist(), strict=True))  # word to the shard's term
        tf, least = unpack(row["most"], np.uint32)[at].astype(np.int64), unpack(row["least"], np.uint32)[at]
        m = np.array([FREE + 25 * x * n // total for x in least.tolist()], np.int64)
        self.bound = dict(zip(has.tolist(), (SCALE * tf // (1000 * tf + 12 * m)).tolist(), strict=True))  # the highest contribution that a posting can have
        self.docs, self.counts = unpack(row["docs"], np.uint32), unpack(row["counts"], np.uint32)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in order, and their contributions before the word's weight."""
        if word not in self.lists:
            s, e = self.begin[self.at[word]], self.end[self.at[word]]
            docs, tf = np.cumsum(self.docs[s:e], dtype=np.int64), self.counts[s:e].astype(np.int64)
            self.lists[word] = docs, SCALE * tf // (1000 * tf + 12 * self.m[docs])
        return self.lists[word]


def searched(own: Shard, item: dict[int, int], floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that score at least floor (above 0) for an item {word: weight times occurrences}, and their scores."""
    own_words = sorted((w for w in item if w in own.at and item[w] > 0), key=lambda w: item[w] * own.bound[w])
    sums = np.cumsum([item[w] * own.bound[w] for w in own_words], dtype=np.int64)
    split = int(np.searchsorted(sums, floor))  # the first ones' sum stays below floor
    if split == len(own_words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    score = np.zeros(len(own.ids), np.int64)
    for w in own_words[split:]:
        docs, worth = own.postings(w)
        score[docs] += item[w] * worth
    alive = np.flatnonzero(score)
    for k in range(split - 1, -1, -1):
        alive = alive[score[alive] + sums[k] >= floor]
        if not len(alive):
            break
        docs, worth = own.postings(own_words[k])
        if len(alive) * 16 < len(docs):
            at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            hit = docs[at] == alive
            score[alive[hit]] += item[own_words[k]] * worth[at[hit]]
        else:
            score[docs] += item[own_words[k]] * worth  # documents that are out stay out
    alive = alive[score[alive] >= floor]
    return alive, score[alive]


class Best:
    """An item's best documents so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = 1

    def add(self, ids: np.ndarray, scores: np.ndarray):
        if len(ids):
            ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[order], scores[order]
            if len(order) == self.k:
                self.floor = int(self.scores[-1])


def search_block(shards: DataFrame, items: list[Counter], k: int) -> DataFrame:
    """(item, id, score): each task's best documents for each item, numbered by its place in the list."""
    asked_words = sorted({w for item in items for w in item})
    number = {w: i for i, w in enumerate(asked_words)}
    n, total, held = statistics(shards, asked_words)
    weight = weights(held, n)
    asked = [{number[w]: weight[number[w]] * c for w, c in item.items() if number[w] in weight} for item in items]

    def run(batches):
        vocabulary, found = pa.array(asked_words, pa.large_string()), [Best(k) for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                own = Shard({c: batch.column(c)[i].as_py() for c in PARTS}, vocabulary, n, total)
                for best, item in zip(found, asked, strict=True):
                    docs, scores = searched(own, item, best.floor)
                    best.add(own.ids[docs], scores)
        yield pa.RecordBatch.from_pydict(
            {"item": pa.array(np.repeat(np.arange(len(found)), [len(b.ids) for b in found]), pa.int32()), "id": pa.array(np.concatenate([b.ids for b in found])), "score": pa.array(np.concatenate([b.scores for b in found]))}
        )

    return shards.mapInArrow(run, FOUND)


def search(shards: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each item (item_id, text).

    Items without terms, or with none that a document holds, have no rows. Rows of items that repeat are searched once; items that share an item_id
    but not the text, or have none, have ranks of their own. Documents with a score of 0 are left out.
    """
    spark = shards.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = X.written(items, "items")
    blocks = -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // ITEM_BYTES)
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).sort("item_id", "text").toArrow()  # about ITEM_BYTES
        if not rows.num_rows:
            continue
        terms, row = terms_of(rows.column("text").combine_chunks())
        asked = [Counter() for _ in range(rows.num_rows)]
        for w, r in zip(terms.to_pylist(), row.tolist(), strict=True):
            asked[r][w] += 1
        with X.setting(spark, X.BATCH, str(BATCH_BYTES)):
            found = X.written(search_block(shards, asked, k), "found")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(rows.column("item_id").to_pylist())], f"item int, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        own = ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("id") != X.NULL_ID, F.col("id")).alias("doc_id"), "score")
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    shards = stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(shards, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


OP13_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
docs AS (SELECT d, doc_id, len(ws)::BIGINT AS n FROM cut WHERE len(ws) > 0),
total AS (SELECT count(*)::HUGEINT AS big_n, sum(n)::HUGEINT AS l FROM docs),
tf AS (SELECT d, word, count(*) AS tf FROM (SELECT d, unnest(ws) AS word FROM cut) GROUP BY d, word),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
items AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
asked AS (
  SELECT i, word, count(*) AS qtf FROM (
    SELECT i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM items) GROUP BY i, word),
scored AS (
  SELECT i, d, sum(qtf * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))))::BIGINT AS score
  FROM asked JOIN df USING (word) JOIN tf USING (word) JOIN docs USING (d), total GROUP BY i, d)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM scored JOIN docs USING (d) JOIN items USING (i) WHERE score > 0 QUALIFY rank <= 20
"""
