"""Packed exchanges: how the fingerprint operators move many small values cheaply.

A *chunk* is a run of documents that one task reads together (about 2 MB of
text). It sends each distinct fingerprint once, with what it knows of it, to
the *bucket* named by the fingerprint's top bits, as one binary row for each
bucket; so a passage that a third of all documents hold costs one entry a chunk,
and is aggregated before the shuffle. The bucket answers each chunk, and the
chunk, whose header row has travelled along, turns answers into places in its
documents. Chunks and buckets are bounded groups, whatever the input's skew.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.kernels import pack, slices, text_bytes, unpack

ROW = "bucket long, chunk long, kind int, n long, a binary, b binary, c binary, d binary, e binary"
ARROW_ROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), *((x, pa.binary()) for x in "abcde")])
FOUND = "_id long, _th long, spots binary, more binary"
ARROW_FOUND = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("spots", pa.binary()), ("more", pa.binary())])
HEADER, ITEMS, ANSWER = 0, 1, 2
NULL_ID = -(1 << 63)
BYTES_A_BUCKET = 32 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For a table of rows of megabytes: row groups of a few of them, as a task holds a whole one when it writes or reads; sizes are looked at after each row. The writer would
#: keep the least and the greatest value of each row group, whole, until the file is closed.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.column.statistics.enabled": "false", "parquet.enable.dictionary": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; the warehouse only where none is set and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_cadenza"
    return folder.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the jobs that run within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, removals: list[Callable[[], None]] | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, with options of the writer, and read back; removed when the driver ends, or when what is appended to removals is called.

    The write's shuffles go with it; else they stay on disk until the driver's JVM happens to collect their plans.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cadenza-{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.options(**options).parquet(path)

    def remove():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has gone; the folder's owner expires it
            pass

    atexit.register(remove)
    if removals is not None:
        removals.append(remove)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int | None:
    """Bytes of the tables that a DataFrame reads, as Spark knows them; None if it does not, as for data made in memory."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return total if total < 1 << 60 else None


def bucket_bits(df: DataFrame) -> int:
    """Buckets in proportion to the input, a power of two: 512 at least, so that a few do not make a partition, and as many as it takes."""
    size = size_of(df)
    return 10 if size is None else int(max(9, np.ceil(np.log2(max(1, size / BYTES_A_BUCKET)))))


def partitions(df: DataFrame) -> int:
    """Shuffle partitions as set, more where each would get over 64 MB of the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size_of(df) or 0) // (64 << 20))


def keyed(documents: DataFrame, text: str = "text", key: str = "doc_id", whole: bool = False) -> DataFrame:
    """Rows with a key that is never null; rows that repeat key and text share it. whole: ``_doc`` holds all columns but the text."""
    doc = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != text)) if whole else F.col(key)
    return documents.select(doc.alias("_doc"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).cast("string").alias("text"))


def unkeyed(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The columns of documents from rows keyed whole."""
    return rows.select(*(F.col("text").cast(documents.schema["text"].dataType).alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in documents.columns))


def free(columns: list[str], *names: str) -> list[str]:
    """Names of which no column has one yet, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Chunk:
    """One slice of documents being read."""

    def __init__(self, number: int, batch: pa.RecordBatch):
        self.number, self.batch = number, batch
        self.data, self.offsets = text_bytes(batch.column("text"))
        self.ids = batch.column("_id").to_numpy(zero_copy_only=False)
        self.hashes = batch.column("_th").to_numpy(zero_copy_only=False)

    def header(self, starts: np.ndarray, places: np.ndarray, entry: np.ndarray) -> dict:
        """What is needed to turn answers into places: places sorted, entry: the item of each."""
        head = np.concatenate([self.ids, self.hashes, starts]).astype(np.int64)
        return {"bucket": (1 << 40) + self.number, "chunk": self.number, "kind": HEADER, "n": len(self.ids), "a": head.tobytes(), "b": pack(np.diff(places, prepend=0).astype(np.uint32)), "c": pack(steps(entry)), "d": b"", "e": b""}

    def items(self, fingerprints: np.ndarray, bits: int, columns: Callable[[np.ndarray], dict[str, bytes]], kind: int = ITEMS, keep=np.uint64) -> Iterator[dict]:
        """Rows of distinct fingerprints, by bucket; columns(chosen) gives what else is told of them."""
        where = fingerprints >> np.uint64(64 - bits)
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.diff(where[order], prepend=np.uint64(1 << 63)))
        for s, e in zip(edges, [*edges[1:], len(order)], strict=True):
            chosen = order[s:e]
            yield {"bucket": int(where[chosen[0]]), "chunk": self.number, "kind": kind, "n": len(chosen), "a": pack(fingerprints[chosen].astype(keep)), "b": pack(np.diff(chosen, prepend=0).astype(np.uint32)), "c": b"", "d": b"", "e": b""} | columns(chosen)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    number = TaskContext.get().partitionId() << 20
    for batch in batches:
        for part in slices(batch):
            yield Chunk(number, part)
            number += 1


def emit(rows: Iterator[dict], schema: pa.Schema, every: int = 4096, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    got, size = [], 0
    for r in rows:
        got.append(r)
        size += sum(len(x) for x in r.values() if isinstance(x, bytes))
        if len(got) >= every or size >= limit:
            yield pa.RecordBatch.from_pylist(got, schema=schema)
            got, size = [], 0
    if got:
        yield pa.RecordBatch.from_pylist(got, schema=schema)


def sent(df: DataFrame, read: Callable[[Chunk], Iterator[dict]]) -> DataFrame:
    """Map chunks of (_doc, _id, _th, text, ...) to exchange rows."""

    def run(batches):
        yield from emit((row for chunk in chunks(batches) for row in read(chunk)), ARROW_ROW)

    return df.mapInArrow(run, ROW)


class Items:
    """What came to one bucket: fingerprints and, for each, its chunk's row and its entry there."""

    def __init__(self, rows: list[dict], keep=np.uint64):
        self.rows = rows
        self.sizes = np.array([r["n"] for r in rows], np.int64)
        self.prints = np.concatenate([unpack(r["a"], keep) for r in rows])

    def column(self, name: str, dtype) -> np.ndarray:
        return np.concatenate([unpack(r[name], dtype) for r in self.rows])

    def answers(self, chosen: np.ndarray, value: np.ndarray) -> Iterator[dict]:
        """For each chunk, the chosen entries and their values."""
        end = np.cumsum(self.sizes)
        for r, s, e in zip(self.rows, end - self.sizes, end, strict=True):
            own = np.flatnonzero(chosen[s:e])
            if len(own):
                entry = np.cumsum(unpack(r["b"], np.uint32), dtype=np.int64)[own]
                yield {"bucket": r["bucket"], "chunk": r["chunk"], "kind": r["kind"] + ANSWER, "n": len(own), "a": pack(np.diff(entry, prepend=0).astype(np.uint32)), "b": pack(value[s:e][own].astype(np.uint32)), "c": b"", "d": b"", "e": b""}


def groups(prints: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal fingerprints together and where each group starts; more: their other 64 bits, if they have them."""
    order = np.argsort(prints, kind="stable") if more is None else np.lexsort((more, prints))
    if not len(prints):
        return order, np.zeros(0, np.int64)
    new = prints[order][1:] != prints[order][:-1]
    if more is not None:
        new |= more[order][1:] != more[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    return order, first


def answered(exchange: DataFrame, decide: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
    """Hand each bucket's item rows to decide; headers pass."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [r for r in rows if r["kind"] == HEADER]
        if len(out) < len(rows):
            out += decide(sorted((r for r in rows if r["kind"] != HEADER), key=lambda r: (r["chunk"], r["kind"])))
        return pa.Table.from_pylist(out, schema=ARROW_ROW)

    return exchange.groupBy("bucket").applyInArrow(run, ROW)


class Answers:
    """A chunk's header and the answers to it."""

    def __init__(self, rows: list[dict]):
        self.head = head = next(r for r in rows if r["kind"] == HEADER)
        n = head["n"]
        a = np.frombuffer(head["a"], np.int64)
        self.ids, self.hashes, self.starts = a[:n], a[n : 2 * n], a[2 * n :]
        self.places = np.cumsum(unpack(head["b"], np.uint32), dtype=np.int64)
        self.entry = from_steps(unpack(head["c"], np.uint32))
        self.rows = rows

    def values(self, kind: int, n: int) -> np.ndarray:
        """The value answered for each entry, 0 if none was."""
        out = np.zeros(n, np.uint32)
        for r in self.rows:
            if r["kind"] == kind + ANSWER:
                out[np.cumsum(unpack(r["a"], np.uint32), dtype=np.int64)] = unpack(r["b"], np.uint32)
        return out

    def by_document(self, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Document, first and last index of its share of sorted places."""
        cuts = np.searchsorted(places, self.starts)
        for k in np.flatnonzero(np.diff(cuts)):
            yield int(k), int(cuts[k]), int(cuts[k + 1])


def collected(exchange: DataFrame, conclude: Callable[[Answers], Iterator[dict]]) -> DataFrame:
    """Bring each chunk's answers to its header, also where it got none; conclude yields rows of FOUND."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(conclude(Answers(table.to_pylist()))), schema=ARROW_FOUND)

    return exchange.groupBy("chunk").applyInArrow(run, FOUND)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo 2**32: mostly 1 for entries in order."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0))


def from_steps(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=np.uint32)


def joined(starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Sorted ranges without overlap, neighbours joined, as a blob."""
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] > ends[:-1])
    return as_ranges(starts[np.append(0, cut + 1)], ends[np.append(cut, len(ends) - 1)])


def ranges(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends from packed pairs, one blob or several."""
    both = [np.frombuffer(b, np.int64).reshape(2, -1) for b in blobs or () if b]
    if not both:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate(both, axis=1)
    return both[0], both[1]


def as_ranges(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.concatenate([starts, ends]).astype(np.int64).tobytes()
