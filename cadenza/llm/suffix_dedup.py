"""Exact repeats of at least ``min_bytes`` bytes, by a logarithmic family of sampled suffix arrays.

Suffixes are sampled by content: within every ``min_bytes`` bytes the suffix
whose leading ``PREFIX`` bytes have the least fingerprint is taken, so two equal
stretches of that length have a sampled suffix at the same offset, and about one
byte in fifty starts one. The corpus enters an :class:`Index` in batches. A batch's array holds its sampled
suffixes by the fingerprint of their leading bytes, a sorted run for each bucket of a table in the shared folder; it is
merge-scanned against the arrays of the index's levels for suffixes with equal leading
bytes, and enters the family at level 0; two arrays of equal rank merge into one of the next.

A suffix owns the ``min_bytes`` strings in which it is the one sampled. If all of
these together repeat (its context), they are settled. The strings that the others
own, at the ends of repeats, are compared themselves by a second exchange,
together with those of one witness for each repeated context that also has partial matches.

A match of leading bytes (64 bits) only makes a candidate. Contexts and strings are compared by fingerprints of
128 bits, two hash chains that are independent of each other by a key that is drawn for each index, and equal ones are taken as equal strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import exchange as X
from cadenza.llm.kernels import byte_windows, chains, covered, fuse, mix, pack, runs, secret, sliding_min, text_bytes, unpack

PREFIX = 96
BATCHES = 4
LEADING, CONTEXT, LEVEL, MATCH = 1, 5, 9, 10  # kinds of rows; the kind of an answer is larger by 2
PLACE = np.uint64((1 << 32) - 1)
FIRST, MANY = np.uint32(1 << 31), np.uint32((1 << 31) - 1)
ARRAY = "bucket long, a binary, c binary"
ARROW_ARRAY = pa.schema([("bucket", pa.int64()), ("a", pa.binary()), ("c", pa.binary())])


def arrayed(rows: DataFrame) -> DataFrame:
    """One row for each bucket: its distinct fingerprints in order and how often each starts, from runs of any number."""

    def merge(table: pa.Table) -> pa.Table:
        prints = np.concatenate([unpack(x, np.uint64) for x in table.column("a").to_pylist()])
        counts = np.concatenate([unpack(x, np.uint32) for x in table.column("c").to_pylist()]).astype(np.int64)
        order, first = X.groups(prints)  # runs that are sorted merge
        total = np.minimum(np.add.reduceat(counts[order], first), int(MANY)).astype(np.uint32) if len(first) else counts.astype(np.uint32)
        return pa.Table.from_pylist([{"bucket": table.column("bucket")[0].as_py(), "a": pack(prints[order][first]), "c": pack(total)}], schema=ARROW_ARRAY)

    return rows.select("bucket", "a", "c").groupBy("bucket").applyInArrow(merge, ARRAY)


def matched(new: DataFrame, old: DataFrame) -> DataFrame:
    """The suffixes of a new array that an old one holds too: one merge-scan for each bucket."""

    def scan(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.Table.from_pylist([], schema=ARROW_ARRAY)
        prints, level = (unpack(x.column("a")[0].as_py(), np.uint64) for x in (one, two))
        both = np.intersect1d(prints, level, assume_unique=True)
        return pa.Table.from_pylist([{"bucket": one.column("bucket")[0].as_py(), "a": pack(both), "c": b""}] if len(both) else [], schema=ARROW_ARRAY)

    return new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(scan, ARRAY)


def repeated(array: DataFrame) -> DataFrame:
    """The suffixes of an array that start more than once in it."""

    def run(batches):
        for batch in batches:
            for bucket, a, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "a", "c")), strict=True):
                prints = unpack(a, np.uint64)[unpack(c, np.uint32) > 1]
                if len(prints):
                    yield pa.RecordBatch.from_pylist([{"bucket": bucket, "a": pack(prints), "c": b""}], schema=ARROW_ARRAY)

    return array.mapInArrow(run, ARRAY)


class Index:
    """Levels of suffix arrays as tables: level k holds 2**k batches or is missing, as in a binary counter.

    bits, min_bytes, prefix and key must stay the same for an index's life. Levels are never changed, only replaced, so
    an answer that has been planned stays good. Write ``levels`` elsewhere to keep them beyond the session.
    What is in ``removals`` removes the index's tables, once no answer that was planned is to be computed any more.
    """

    def __init__(self, min_bytes: int = 200, prefix: int | None = None, bits: int = 9, levels: dict[int, DataFrame] | None = None, key: bytes | None = None):
        self.size, self.bits, self.levels = min_bytes, bits, dict(levels or {})
        self.prefix = prefix or min(PREFIX, max(1, min_bytes // 3))
        self.key = key or secret()
        self.removals = []

    def read(self, texts: DataFrame) -> DataFrame:
        """Exchange rows of keyed texts: headers, and what each chunk knows of its suffixes and contexts."""
        bits, size, prefix, key = self.bits, self.size, self.prefix, self.key
        return X.sent(texts, lambda c: _read(c, bits, size, prefix, key))

    def enter(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Enter a batch's exchange rows: suffixes that repeat within the batch, and those that older batches hold too."""
        array = X.written(arrayed(rows.where(F.col("kind") == LEADING)), "level", self.removals)
        within, shared = repeated(array), None
        for level in self.levels.values():
            found = matched(array, level)
            shared = found if shared is None else shared.unionByName(found)
        rank = 0
        while rank in self.levels:
            array = X.written(arrayed(array.unionByName(self.levels.pop(rank))), "level", self.removals)
            rank += 1
        self.levels[rank] = array
        return within, within.limit(0) if shared is None else shared

    def add(self, documents: DataFrame) -> DataFrame:
        """Enter documents; ``_id, _th, spots``: the ranges of starts of strings whose sampled suffix older batches hold too, candidates."""
        rows = X.written(self.read(X.keyed(documents)), "batch").where(F.col("kind") != CONTEXT)
        _, shared = self.enter(rows)

        def answer(rows):
            items = X.Items([r for r in rows if r["kind"] == LEADING])
            known = [unpack(r["a"], np.uint64) for r in rows if r["kind"] == MATCH]
            hit = np.isin(items.prints, np.concatenate(known)) if known else np.zeros(len(items.prints), bool)
            yield from items.answers(hit, np.ones(len(hit), np.uint32))

        def matches(answers):
            hit = answers.values(LEADING, int(answers.entry.max()) + 1)[answers.entry] > 0
            blob = answers.head["d"]
            width = unpack(blob[len(blob) // 2 :], np.uint32).astype(np.int64) + 1
            told = np.flatnonzero(hit)
            for k, s, e in answers.by_document(answers.places[told]):
                lo = answers.places[told[s:e]] - answers.starts[k]
                yield {"_id": int(answers.ids[k]), "_th": int(answers.hashes[k]), "spots": X.joined(lo, lo + width[told[s:e]]), "more": b""}

        return X.collected(X.answered(rows.unionByName(as_rows(shared, MATCH)), answer), matches)


def as_rows(array: DataFrame, kind: int) -> DataFrame:
    """An array in the exchange's columns."""
    none = F.lit(b"")
    return array.select("bucket", F.lit(-1).cast("long").alias("chunk"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("n"), "a", none.alias("b"), "c", none.alias("d"), none.alias("e"))


def sampled(data: np.ndarray, offsets: np.ndarray, size: int, prefix: int, key: bytes) -> tuple[np.ndarray, ...]:
    """The sampled suffixes of a chunk: fingerprint of the leading bytes, first and last of the strings that each owns, 128 bits of those.

    Every string of ``size`` bytes inside a document is owned by the leftmost least fingerprint of ``prefix`` bytes in it.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(data)
    if n < size:
        return none
    first_chain, second_chain = chains(key)
    lead, one = byte_windows(data, prefix, size, chain=first_chain)
    (two,) = byte_windows(data, size, chain=second_chain)
    # the upper 32 bits decide, then the left: the same in every text that a string stands in, whatever its length
    owner = sliding_min((lead & ~PLACE) | np.arange(len(lead), dtype=np.uint64), size - prefix + 1) & PLACE
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(offsets[1:-1] - size + 1, 0), 1)
    np.add.at(edge, offsets[1:-1], -1)
    inside = np.flatnonzero(np.cumsum(edge)[: len(owner)] <= 0)
    if not len(inside):
        return none
    owner = owner[inside].astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    at, lo, hi = owner[first], inside[first], inside[np.append(first[1:], len(owner)) - 1]
    # two strings that overlap are their context; the shape tells where the suffix lies in it
    shape = ((at - lo) * 4 * size + (hi - at)).astype(np.uint64) + np.uint64(1)
    contexts = (mix(fuse(fuse(x[lo], x[hi], chain), mix(shape, chain), chain), chain) for x, chain in ((one, first_chain), (two, second_chain)))
    return lead[at], lo, hi, *contexts


def distinct(prints: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of distinct values in order, the entry of each place, and how often each occurs."""
    if more is None:
        _, first, entry, count = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    else:
        at, begin = X.groups(prints, more)
        count = np.diff(np.append(begin, len(at)))
        entry = np.empty(len(at), np.int64)
        entry[at] = np.repeat(np.arange(len(begin)), count)
        first = at[begin]  # the order is stable
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return first[order], rank[entry], count[order]


def _read(chunk: X.Chunk, bits: int, size: int, prefix: int, key: bytes):
    lead, lo, hi, context, more = sampled(chunk.data, chunk.offsets, size, prefix, key)
    if not len(lo):
        return
    leads, own, count = distinct(lead)
    contexts, whole, many = distinct(context, more)
    yield chunk.header(chunk.offsets, lo, own) | {"d": pack(X.steps(whole)) + pack((hi - lo).astype(np.uint32))}
    for row in chunk.items(lead[leads], bits, lambda chosen: {"c": pack(count[chosen].astype(np.uint32))}, LEADING):
        yield row | {"bucket": row["bucket"] * 2}
    more = more[contexts]
    for row in chunk.items(context[contexts], bits, lambda chosen: {"c": pack(many[chosen].astype(np.uint32)), "e": more[chosen].tobytes()}, CONTEXT):
        yield row | {"bucket": row["bucket"] * 2 + 1}  # the two kinds have buckets of their own


def _decide(rows: list[dict]):
    """Answer how often each entry's suffix or context starts anywhere, if more than once; a context's first entry is its witness."""
    own = [r for r in rows if r["kind"] in (LEADING, CONTEXT)]
    if not own:
        return
    items = X.Items(own)
    if own[0]["kind"] == LEADING:  # matches came from the index, counts from its levels
        told = [unpack(r["a"], np.uint64) for r in rows if r["kind"] == MATCH]
        if not told:
            return
        known = np.unique(np.concatenate(told))
        total = np.zeros(len(known), np.int64)
        for r in rows:
            if r["kind"] == LEVEL:
                level = unpack(r["a"], np.uint64)
                at = np.minimum(np.searchsorted(level, known), len(level) - 1)
                total += np.where(level[at] == known, unpack(r["c"], np.uint32)[at], 0)
        at = np.minimum(np.searchsorted(known, items.prints), len(known) - 1)
        hit = known[at] == items.prints
        yield from items.answers(hit, np.minimum(total[at], int(MANY)).astype(np.uint32))
        return
    order, first = X.groups(items.prints, np.concatenate([np.frombuffer(r["e"], np.uint64) for r in own]))
    count = np.add.reduceat(items.column("c", np.uint32).astype(np.int64)[order], first)
    value = np.empty(len(order), np.uint32)
    value[order] = np.repeat(np.minimum(count, int(MANY)).astype(np.uint32), np.diff(np.append(first, len(order))))
    hit = value > 1
    value[order[first]] |= FIRST  # chunks come in order
    yield from items.answers(hit, value)


def _conclude(answers: X.Answers, size: int):
    """Strings settled as repeated, and strings to compare, as ranges of starts in each document."""
    blob = answers.head["d"]
    whole, width = X.from_steps(unpack(blob[: len(blob) // 2], np.uint32)), unpack(blob[len(blob) // 2 :], np.uint32).astype(np.int64) + 1
    lead = answers.values(LEADING, int(answers.entry.max()) + 1)[answers.entry] & MANY
    context = answers.values(CONTEXT, int(whole.max()) + 1)[whole]
    _, first = np.unique(whole, return_index=True)
    witness = np.zeros(len(whole), bool)
    witness[first] = True
    settled = (context & MANY) > 1
    asked = (lead > 1) & (~settled | (witness & ((context & FIRST) > 0) & (lead > (context & MANY))))
    told = np.flatnonzero(settled | asked)
    for k, s, e in answers.by_document(answers.places[told]):
        own = told[s:e]
        lo = answers.places[own] - answers.starts[k]
        blobs = [X.joined(lo[m], lo[m] + width[own[m]]) for m in (settled[own], asked[own])]
        yield {"_id": int(answers.ids[k]), "_th": int(answers.hashes[k]), "spots": blobs[0], "more": blobs[1]}


def _windows(chunk: X.Chunk, bits: int, size: int, key: bytes):
    """The strings to compare in a chunk."""
    asked = chunk.batch.column("more").to_pylist()
    places = []
    for k, blob in enumerate(asked):
        for s, e in zip(*X.ranges([blob]), strict=True):
            places.append(np.arange(s, e) + chunk.offsets[k])
    if not places:
        return
    places = np.unique(np.concatenate(places))
    prints, more = (byte_windows(chunk.data, size, chain=chain)[0][places] for chain in chains(key))
    first, entry, count = distinct(prints, more)
    more = more[first]
    yield chunk.header(chunk.offsets, places, entry)
    yield from chunk.items(prints[first], bits, lambda chosen: {"c": np.packbits(count[chosen] > 1).tobytes(), "e": more[chosen].tobytes()})


def _repeated(rows: list[dict]):
    items = X.Items(rows)
    many = np.concatenate([np.unpackbits(np.frombuffer(r["c"], np.uint8))[: r["n"]] for r in rows]).astype(bool)
    order, first = X.groups(items.prints, np.concatenate([np.frombuffer(r["e"], np.uint64) for r in rows]))
    size = np.diff(np.append(first, len(order)))
    hit = np.zeros(len(order), bool)
    hit[order] = np.repeat(size > 1, size)
    yield from items.answers(hit | many, np.ones(len(order), np.uint32))


def _spots(answers: X.Answers):
    hit = answers.values(X.ITEMS, int(answers.entry.max()) + 1)[answers.entry] > 0
    places = answers.places[hit]
    for k, s, e in answers.by_document(places):
        own = places[s:e] - answers.starts[k]
        yield {"_id": int(answers.ids[k]), "_th": int(answers.hashes[k]), "spots": X.joined(own, own + 1), "more": b""}


def repeated_windows(documents: DataFrame, min_bytes: int = 200, prefix: int | None = None, batches: int = BATCHES, whole: bool = False) -> DataFrame:
    """Documents with ``_doc, _id, _th, text`` and ``found``: blobs of ranges of starts of repeated strings.

    Null and empty texts, and texts under ``min_bytes`` bytes, have none. Rows
    that repeat a ``doc_id`` and its text are copies of each other. Any other column is ignored.
    """
    bits = X.bucket_bits(documents)
    texts = X.keyed(documents, whole=whole)
    index = Index(min_bytes, prefix, bits)
    rows = X.written(index.read(texts), "suffixes", index.removals)
    told = rows
    for b in range(batches):
        batch = rows.where(F.pmod(F.xxhash64("chunk"), F.lit(batches)) == b)
        for found in index.enter(batch):
            told = told.unionByName(as_rows(found, MATCH))
    for level in index.levels.values():
        told = told.unionByName(as_rows(level, LEVEL))
    known = X.written(X.collected(X.answered(told, _decide), lambda a: _conclude(a, min_bytes)), "repeats")
    for remove in index.removals:  # all that follows needs is in known and the texts
        remove()
    by_key = texts.repartition(X.partitions(documents), "_id", "_th")
    asked = known.where(F.length("more") > 0).groupBy("_id", "_th").agg(F.first("more").alias("more"))
    compared = by_key.join(asked, ["_id", "_th"]).select("_doc", "_id", "_th", "text", "more").sortWithinPartitions("_id", "_th")
    key = index.key
    out = X.answered(X.sent(compared, lambda c: _windows(c, bits, min_bytes, key)), _repeated)
    late = X.collected(out, _spots)
    found = known.where(F.length("spots") > 0).select("_id", "_th", "spots").unionByName(late.select("_id", "_th", "spots"))
    found = found.groupBy("_id", "_th").agg(F.collect_list("spots").alias("found"))
    return by_key.join(found, ["_id", "_th"], "left").select("_doc", "_id", "_th", "text", "found")


def removal(found, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that repeated strings cover."""
    starts, ends = X.ranges(found)
    if not len(starts):
        return starts, ends
    return runs(covered(starts, ends + size - 1, n))


def cut_texts(documents: DataFrame, min_bytes: int = 200) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans, kept (bytes left)."""

    def run(batches):
        for batch in batches:
            for part in X.slices(batch):
                data, offsets = text_bytes(part.column("text"))
                found = part.column("found").to_pylist()
                rows = []
                for k, blobs in enumerate(found):
                    own = data[offsets[k] : offsets[k + 1]]
                    s, e = removal(blobs, len(own), min_bytes)
                    kept = own
                    if len(s):
                        kept = own[~covered(s, e, len(own))]
                    rows.append((len(own), int((e - s).sum()), len(s), np.stack([s, e], 1).tolist() if len(s) else [], kept.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("_doc"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    out = repeated_windows(documents, min_bytes)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")


def without_repeats(documents: DataFrame, min_bytes: int = 200) -> DataFrame:
    """The same rows and columns, with repeats cut from the texts to whole characters and ``n_chars``, if there, counted anew."""

    def run(batches):
        for batch in batches:
            for part in X.slices(batch):
                column, texts = part.column("text"), []
                data, offsets = text_bytes(column)
                inner = (data & 0xC0) == 0x80  # bytes within a character
                for k, blobs in enumerate(part.column("found").to_pylist()):
                    a, b = offsets[k], offsets[k + 1]
                    own, within = data[a:b], inner[a:b]
                    s, e = removal(blobs, b - a, min_bytes)
                    if not len(s):
                        texts.append(None if not column[k].is_valid else own.tobytes())
                        continue
                    gone = covered(s, e, b - a)
                    starts = np.flatnonzero(~within)
                    whole = np.logical_and.reduceat(gone, starts)
                    gone = np.repeat(whole, np.diff(np.append(starts, b - a)))
                    texts.append(own[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("_doc"), pa.array(texts, pa.binary()).cast(pa.string())], names=["_doc", "text"])

    out = repeated_windows(documents, min_bytes, whole=True)
    out = out.mapInArrow(run, f"_doc {out.schema['_doc'].dataType.simpleString()}, text string")
    columns = [F.col("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in documents.columns]
    out = out.select(*columns)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = cut_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM docs)),
many AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM many)),
gone AS (SELECT r, run, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY r, run),
cut AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM gone),
told AS (SELECT r, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, max(e) AS last, string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM cut JOIN docs USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN told USING (r)
"""
