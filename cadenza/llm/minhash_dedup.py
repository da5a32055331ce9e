"""Near-duplicate documents by SetSketch registers.

Each distinct shingle set gets ``BANDS * ROWS`` registers. A register is the least of
the set's values under its own hash, as a truncated step on the exponential scale
with base ``BASE``: sketches merge by the larger register, and equal registers are
locality-sensitive. Bands of equal registers give buckets, and buckets that share a set
give groups (each set meets its bucket's least one: a star, never all pairs). Within a
group, sets of different components are
compared: sketches estimate similarity jointly by maximum likelihood, and what may reach the threshold is
verified on the full shingle sets from the texts. Only links that join two
components leave the task, fewer than its sets.

A group beyond one block is compared in two steps. First each block's sets among themselves and with the group's
pivots, a few of its sets that every block gets: near copies of one text become one component there. What is
left is pairs of unlike components, and of such a pair one lies outside the group's largest component: those sets, in
blocks, meet all blocks. A group of near copies costs what its size is; only a group of many
unlike components costs more.

A pair at the threshold shares no band with probability (1 - 0.8**6)**38 < 1e-5; a chance pair of similarity 0.3 shares one with 0.03.
Sets are named by a digest of their shingles' hashes, 128 bits each; shingles within a pair of sets are compared by 64. The hashes have a key that is drawn
for each run, so that no text can be written to collide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import exchange as X
from cadenza.llm.kernels import chains, secret, sequences, slices, text_bytes, word_hashes, words

BANDS, ROWS, BASE = 38, 6, 1.01
BLOCK_SETS, BLOCK_SHINGLES, PIVOTS = 4096, 4_000_000, 16
_rng = np.random.Generator(np.random.PCG64(8))
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
SKETCHES = "_id long, _th long, n_shingles long, node binary, registers binary"
ARROW_SKETCHES = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("registers", pa.binary())])
PAIRS = "a binary, b binary"
ARROW_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def shingle_sets(column: pa.Array, size: int, key: bytes, names: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Sorted distinct shingle hashes of each row, end to end, where each row begins, and, if asked for, each row's name.

    A row with fewer words than ``size`` has its whole sequence as one shingle; one without words has none and no name.
    """
    data, offsets = text_bytes(column)
    starts, ends, first = words(data, offsets)
    both = [sequences(word_hashes(data, starts, ends, lower=True, chain=chain), *range(1, size + 1), chain=chain) for chain in chains(key)[: 1 + names]]
    sets, named = [], []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = min(e - s, size)
        own = [runs[n - 1][s : max(s, e - n + 1)] if n else runs[0][:0] for runs in both]
        order = np.argsort(own[0], kind="stable")
        own = [x[order] for x in own]
        new = np.concatenate([[True], own[0][1:] != own[0][:-1]])[: len(order)]
        sets.append(own[0][new])
        if names:
            named.append(hashlib.blake2b(b"".join(x[new].tobytes() for x in own), digest_size=16).digest() if n else None)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), begin, named


def registers(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows of registers; every row must have a value."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(begin) - 1, BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        least[:, k] = np.minimum.reduceat(short * _A[k] + _B[k], begin[:-1])
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches whose set sizes are known.

    With u, v the shares of the sizes, a register is larger in one sketch with probability u - vJ, in the
    other with v - uJ, and equal with J (to first order in BASE - 1); the likelihood of the counts has its maximum at
    the lesser root of a quadratic equation.
    """
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    m = a.shape[-1]
    same = m - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p, q = u * v * m, same * (u * u + v * v) + more * v * v + less * u * u
    root = (q - np.sqrt(np.maximum(q * q - 4 * p * p * same / m, 0))) / (2 * p)
    return np.minimum(root, np.minimum(u / v, v / u))


def sketches(documents: DataFrame, size: int, key: bytes) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values, begin, nodes = shingle_sets(part.column("text"), size, key, names=True)
                n = np.diff(begin)
                some = np.flatnonzero(n)
                blobs = [None] * len(n)
                if len(some):
                    rows = registers(values, np.append(begin[some], begin[-1]))
                    for i, k in enumerate(some.tolist()):
                        blobs[k] = rows[i].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_th"), pa.array(n), pa.array(nodes, pa.binary()), pa.array(blobs, pa.binary())], schema=ARROW_SKETCHES)

    return X.keyed(documents).select("_id", "_th", "text").mapInArrow(run, SKETCHES)


def banded(nodes: DataFrame) -> DataFrame:
    """Rows (bucket, node): one for each band of each set."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))))
    return nodes.select(F.explode(keys).alias("bucket"), "node")


class Forest:
    """Union-find over the members of one task, some of them joined before."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.links: list[tuple[int, int]] = []

    def join(self, x: int, others: np.ndarray):
        for y in others.tolist():
            a, b = self.label[x], self.label[y]
            if a != b:
                self.label[self.label == max(a, b)] = min(a, b)
                self.links.append((x, y))


def linked(values: np.ndarray, begin: np.ndarray, regs: np.ndarray, label: np.ndarray, first_side: np.ndarray, percent: int, floor: float) -> list[tuple[int, int]]:
    """Links that span the components of a task's distinct sets; label names the components they have already, and pairs need a member of first_side.

    A member is compared with all members of other components at once: by sketches first, then, for those that may
    reach the threshold, by exact intersections. When only one component's members of first_side have not been compared,
    every pair of different components has.
    """
    n = np.diff(begin)
    size = len(n)
    forest = Forest(np.unique(label, return_inverse=True)[1])
    _, token = np.unique(values, return_inverse=True)
    member = np.repeat(np.arange(size), n)
    order = np.argsort(token, kind="stable")
    posting = member[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(token))])
    todo = first_side.copy()
    whole = bool(first_side.all())
    while True:
        labels, count = np.unique(forest.label[todo], return_counts=True)
        if not len(labels) or (whole and len(labels) < 2):
            return forest.links
        # the largest component comes last; its members need no turn where all others have had theirs
        rest = np.flatnonzero(todo & (forest.label != labels[count.argmax()])) if len(labels) > 1 else np.flatnonzero(todo)
        x = int(rest[0])
        todo[x] = False
        ok = forest.label != forest.label[x]
        ok &= 100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])
        may = np.flatnonzero(ok)
        if not len(may):
            continue
        may = may[similarity(regs[x], regs[may], np.float64(n[x]), n[may].astype(np.float64)) >= floor]
        if not len(may):
            continue
        own = token[begin[x] : begin[x + 1]]
        lengths = first[own + 1] - first[own]
        places = np.repeat(first[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[places], minlength=size)[may]
        forest.join(x, may[100 * both >= percent * (n[x] + n[may] - both)])


def compared(rows: DataFrame, size: int, percent: int, key: bytes) -> DataFrame:
    """Links (a, b) in each task (component, i, j); rows have node, text, label (the component so far) and left (may lead a pair)."""
    threshold = percent / 100
    floor = threshold - 6 * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        node = np.array(table.column("node").to_pylist(), object)
        left = table.column("left").to_numpy()
        order = np.lexsort((~left, np.unique(node, return_inverse=True)[1]))  # repeated rows bring equal sets: one stays, of the left if there is
        once = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
        found = []
        if len(once) > 1:
            table = table.take(pa.array(once))
            values, begin, _ = shingle_sets(table.column("text").combine_chunks(), size, key)
            label = np.array(table.column("label").to_pylist(), object)
            found = linked(values, begin, registers(values, begin), label, left[once], percent, floor)
        names = node[once]
        return pa.Table.from_arrays([pa.array([names[x[k]] for x in found], pa.binary()) for k in (0, 1)], schema=ARROW_PAIRS)

    return rows.select("component", "i", "j", "node", "text", "label", "left").groupBy("component", "i", "j").applyInArrow(run, PAIRS)


def confirmed(groups: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int, key: bytes) -> DataFrame:
    """Links (a, b) that span the components of each group of nodes, on whole shingle sets. groups has node and component (the group)."""
    members = groups.join(nodes.select("node", "_id", "_th", "n_shingles"), "node")
    sizes = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))
    members = X.written(members.join(sizes, "component").withColumn("block", block), "members")
    texts = texts.select("_id", "_th", "text").hint("merge")  # the same plan at every size
    # a group's pivots are the least nodes of its first blocks, a bounded list for each
    pivots = members.where((F.col("blocks") > 1) & (F.col("block") < PIVOTS)).groupBy("component", "block").agg(F.min("node").alias("node"))
    pivots = pivots.groupBy("component").agg(F.collect_list("node").alias("pivots"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    to = members.join(pivots, "component", "left").withColumn("to", F.when(F.array_contains("pivots", F.col("node")), every).otherwise(F.array("block")))
    held = texts.join(to.select("_id", "_th", "component", "node", "blocks", "to"), ["_id", "_th"])
    held = X.written(held.select("component", "node", "blocks", "to", "text"), "texts")  # texts that are compared, shuffled once
    within = held.select("component", F.explode("to").alias("i"), "node", "text")
    alone = within.select("component", "i", F.lit(0).cast("long").alias("j"), "node", "text", F.col("node").alias("label"), F.lit(True).alias("left"))
    links = X.written(compared(alone, size, percent, key), "links")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return links
    # what the blocks did not join: sets outside the largest component of their group against all of it
    label = X.written(components(links), "labels")
    large = large.join(label.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    most = large.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    large = X.written(large.join(most, "component").withColumn("outside", F.col("label") != F.col("most")), "outside")
    shares = large.where("outside").groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    large = large.join(shares, "component").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")))
    parts = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    one = F.transform(parts, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("left")))
    two = F.when(F.col("outside"), F.transform(every, lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(True).alias("left")))).otherwise(F.filter(one, lambda x: x["left"]))
    rows = large.select("component", "node", "label", F.explode(F.concat(one, two)).alias("t"))
    rows = held.where("blocks > 1").select("node", "text").join(rows, "node").select("component", "t.i", "t.j", "node", "text", "label", "t.left")
    known = label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return known.unionByName(compared(rows, size, percent, key))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for linked nodes, the component named by its least node: alternating large and small stars.

    A round joins the edges with each node's least neighbour. Rounds end when no edge leads on from another's end: then all are stars.
    """
    edges = X.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        # two edges from one end, or one that begins where another ends
        twice = edges.groupBy("u").agg(F.count("*").alias("n")).select("u", (F.col("n") > 1).alias("twice"))
        ends = edges.select(F.col("v").alias("u")).distinct().withColumn("ends", F.lit(True))
        if twice.join(ends, "u", "left").where("twice OR ends").isEmpty():
            break
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = X.written(small.where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct().toDF("node", "component"))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``_id, _th, n_shingles, component_id, kept``.

    Null texts and texts without words have an empty set and stay alone; equal
    sets are one node, however many documents hold them. ``component_id`` is the
    least doc_id in reach; a null doc_id counts as the least. Rows that repeat are
    kept or not together. Extra columns are ignored.
    """
    key = secret()
    sketched = X.written(sketches(documents, size, key), "sketches")
    least = F.min(F.struct("_id", "_th")).alias("least")
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    nodes = X.written(nodes.select("node", "least._id", "least._th", "n_shingles", "registers"), "nodes")
    texts = X.keyed(documents).select("_id", "_th", "text")
    bands = banded(nodes)
    heads = bands.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    star = bands.join(heads, "bucket").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    groups = X.written(components(star), "groups")
    links = confirmed(groups, nodes, texts, size, percent, key)
    joined = X.written(components(links), "components")
    named = joined.join(nodes.select("node", "_id"), "node").groupBy("component").agg(F.min("_id").alias("component_id"))
    label = joined.join(named, "component").select("node", "component_id")
    label = nodes.select("node", "_id").join(label, "node", "left").select("node", F.coalesce("component_id", "_id").alias("component_id"))
    out = sketched.drop("registers").join(label, "node", "left").withColumn("component_id", F.coalesce("component_id", "_id"))
    return out.select("_id", "_th", "n_shingles", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: the least doc_id of each component, once."""
    kept = near_duplicates(documents, size, percent).where("kept").select("_id", "_th").distinct()
    rows = X.keyed(documents, whole=True).join(kept, ["_id", "_th"])
    first = Window.partitionBy("_id", "_th").orderBy("_id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return X.unkeyed(rows, documents)


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
    real = lambda x: F.when(F.col(x) != X.NULL_ID, F.col(x)).alias("doc_id" if x == "_id" else x)
    return out.select(real("_id"), "n_shingles", real("component_id"), "kept")


OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
shingles AS (SELECT DISTINCT r, md5(array_to_string(ws[i : i + 3], ' ')) AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * shared.n >= 80 * (a.n + b.n - shared.n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
least AS (SELECT x AS r, min(doc_id) AS least FROM reach JOIN docs ON docs.r = y GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""
