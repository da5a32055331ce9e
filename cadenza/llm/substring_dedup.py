"""Repeats of at least ``window`` words, by fixed-block anchors.

The index holds the non-overlapping blocks of ``(window + 1) // 2`` words of every
document; every window of ``window`` words contains a whole block. Every rolling
stretch of a block's length probes the index. Around each hit, the windows that
contain it are extended: windows of equal word sequence meet, the earliest stays,
and runs of the others are the maximal repeats that are removed.

Probes travel as 32 bits beyond the bucket's (a chance hit costs a comparison and
changes nothing); windows are compared by fingerprints of 128 bits: two hash chains, independent of each other from the words up, by a key that
is drawn for each run, so that no text can be written to collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import exchange as X
from cadenza.llm.kernels import chains, covered, pack, secret, sequences, unpack, word_hashes, words
from cadenza.llm.suffix_dedup import distinct


def stretches(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of all runs of ``size`` words that stay inside a document."""
    n = int(first[-1])
    ok = np.ones(max(0, n - size + 1), bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(first[1:-1] - size + 1, 0), 1)
    np.add.at(edge, first[1:-1], -1)
    ok &= np.cumsum(edge)[: len(ok)] <= 0
    return np.flatnonzero(ok)


def _probe(chunk: X.Chunk, bits: int, block: int, key: bytes):
    starts, ends, first = words(chunk.data, chunk.offsets)
    if len(starts) < block:
        return
    places = stretches(first, block)
    if not len(places):
        return
    chain, _ = chains(key)
    (prints,) = sequences(word_hashes(chunk.data, starts, ends, chain=chain), block, chain=chain)
    prints = prints[places]
    indexed = (places - first[np.searchsorted(first, places, "right") - 1]) % block == 0
    head, entry, count = distinct(prints)
    prints = prints[head]
    anchor = np.zeros(len(prints), bool)
    anchor[entry[indexed]] = True
    yield chunk.header(first, places, entry)
    yield from chunk.items(prints, bits, lambda chosen: {"c": np.packbits(anchor[chosen]).tobytes(), "d": np.packbits(count[chosen] > 1).tobytes()}, keep=np.uint32)


def flags(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(r[name], np.uint8))[: r["n"]] for r in rows]).astype(bool)


def _hits(rows: list[dict]):
    """Answer the probes that meet an indexed block at another place than their own."""
    items = X.Items(rows, np.uint32)
    order, first = X.groups(items.prints)
    size = np.diff(np.append(first, len(order)))
    places = np.add.reduceat(1 + flags(rows, "d")[order].astype(np.int64), first)
    block = np.logical_or.reduceat(flags(rows, "c")[order], first)
    hit = np.zeros(len(order), bool)
    hit[order] = np.repeat((places > 1) & block, size)
    yield from items.answers(hit, np.ones(len(hit), np.uint32))


def _extend(answers: X.Answers, window: int, block: int):
    """The windows that contain a hit, as ranges of first words."""
    places = answers.places[answers.values(X.ITEMS, int(answers.entry.max()) + 1)[answers.entry] > 0]
    for k, s, e in answers.by_document(places):
        at = places[s:e] - answers.starts[k]
        last = answers.starts[k + 1] - answers.starts[k] - window
        lo, hi = np.maximum(at - (window - block), 0), np.minimum(at, last) + 1
        lo, hi = lo[lo < hi], hi[lo < hi]
        if len(lo):
            lo = np.maximum(lo, np.concatenate([[0], hi[:-1]]))  # hits are in order
            yield {"_id": int(answers.ids[k]), "_th": int(answers.hashes[k]), "spots": b"", "more": X.joined(lo, hi)}


def earliest(prints: np.ndarray, more: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by fingerprint (of two parts), document and start, and where each fingerprint begins in it."""
    order = np.lexsort((starts, ids, more, prints))
    a, b = prints[order], more[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def _windows(chunk: X.Chunk, bits: int, window: int, key: bytes):
    asked = chunk.batch.column("more").to_pylist()
    starts, ends, first = words(chunk.data, chunk.offsets)
    places, doc = [], []
    for k, blob in enumerate(asked):
        for s, e in zip(*X.ranges([blob]), strict=True):
            places.append(np.arange(s, e) + first[k])
            doc.append(np.full(e - s, k))
    if not places:
        return
    places, doc = np.concatenate(places), np.concatenate(doc)
    prints, more = (sequences(word_hashes(chunk.data, starts, ends, chain=chain), window, chain=chain)[0][places] for chain in chains(key))
    order, begin = earliest(prints, more, chunk.ids[doc], places - first[doc])
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    head = order[begin]  # the place that speaks for each fingerprint
    rank = np.empty(len(head), np.int64)
    by_place = np.argsort(head)
    rank[by_place] = np.arange(len(head))
    head = head[by_place]
    ids, at = chunk.ids[doc[head]], (places - first[doc])[head]
    yield chunk.header(first, places, rank[group]) | {"d": pack(X.steps(head))}
    yield from chunk.items(prints[head], bits, lambda chosen: {"c": pack(np.diff(ids[chosen], prepend=0)), "d": pack(at[chosen].astype(np.uint32)), "e": more[head[chosen]].tobytes()})


def _later(rows: list[dict]):
    """Answer the entries whose window starts earlier in another chunk."""
    items = X.Items(rows)
    ids = np.concatenate([np.cumsum(unpack(r["c"], np.int64)) for r in rows])
    starts = items.column("d", np.uint32)
    order, begin = earliest(items.prints, np.concatenate([np.frombuffer(r["e"], np.uint64) for r in rows]), ids, starts)
    size = np.diff(np.append(begin, len(order)))
    least_id, least = np.repeat(ids[order[begin]], size), np.repeat(starts[order[begin]], size)
    late = np.zeros(len(order), bool)
    late[order] = (ids[order] != least_id) | (starts[order] != least)
    yield from items.answers(late, np.ones(len(late), np.uint32))


def _repeats(answers: X.Answers):
    late = answers.values(X.ITEMS, int(answers.entry.max()) + 1)[answers.entry] > 0
    doc = np.searchsorted(answers.starts, answers.places, "right") - 1
    ids, at = answers.ids[doc], answers.places - answers.starts[doc]
    head = X.from_steps(unpack(answers.head["d"], np.uint32))[answers.entry]
    places = answers.places[late | (ids != ids[head]) | (at != at[head])]
    for k, s, e in answers.by_document(places):
        own = places[s:e] - answers.starts[k]
        yield {"_id": int(answers.ids[k]), "_th": int(answers.hashes[k]), "spots": X.joined(own, own + 1), "more": b""}


def repeated_windows(documents: DataFrame, window: int = 20) -> DataFrame:
    """Documents with ``_doc, _id, _th, text`` and ``found``: ranges of starts of windows that also start earlier.

    Earlier is a smaller ``doc_id`` (null is the smallest), or the same one and a
    smaller start; rows that repeat a ``doc_id`` are the same document, so that equal starts
    do not remove each other. Null, empty and short texts have none.
    """
    block = (window + 1) // 2
    bits, key = X.bucket_bits(documents), secret()
    texts = X.keyed(documents)
    out = X.answered(X.sent(texts, lambda c: _probe(c, bits, block, key)), _hits)
    hits = X.written(X.collected(out, lambda a: _extend(a, window, block)), "anchors")
    by_key = texts.repartition(X.partitions(documents), "_id", "_th")
    asked = hits.groupBy("_id", "_th").agg({"more": "first"}).toDF("_id", "_th", "more")
    compared = by_key.join(asked, ["_id", "_th"]).select("_doc", "_id", "_th", "text", "more").sortWithinPartitions("_id", "_th")
    out = X.answered(X.sent(compared, lambda c: _windows(c, bits, window, key)), _later)
    found = X.collected(out, _repeats).groupBy("_id", "_th").agg({"spots": "collect_list"}).toDF("_id", "_th", "found")
    return by_key.join(found, ["_id", "_th"], "left").select("_doc", "_id", "_th", "text", "found")


def cut_words(documents: DataFrame, window: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (its other words, joined by a space)."""

    def run(batches):
        for batch in batches:
            for part in X.slices(batch):
                rows = []
                for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True):
                    own = (text or "").encode().split()
                    n = len(own)
                    s, e = X.ranges(found)
                    if len(s):
                        gone = covered(s, e + window - 1, n)
                        own = [own[i] for i in np.flatnonzero(~gone)]
                    rows.append((n, n - len(own), b" ".join(own)))
                yield pa.RecordBatch.from_arrays([part.column("_doc"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return repeated_windows(documents, window).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept binary")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    cut = cut_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
flat AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1)::BIGINT)) AS i FROM w)),
late AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS gone FROM win),
cover AS (
  SELECT f.doc_id, f.word, f.i,
         coalesce(max(l.gone::INT) OVER (PARTITION BY f.doc_id ORDER BY f.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM flat f LEFT JOIN late l ON f.doc_id = l.doc_id AND f.i = l.i),
kept AS (
  SELECT doc_id, count(*) AS n, sum(gone)::BIGINT AS gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t
  FROM cover GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_words, coalesce(k.gone, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
