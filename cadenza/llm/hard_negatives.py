"""Hard negatives by a Voronoi-partitioned, distributed kNN join on inner products.

Rows get one more component, ``sqrt(M**2 - |x|**2)`` with M the largest norm, so that all lie on one sphere; an anchor is scaled to norm M and
gets 0. Then a larger inner product is a smaller distance: ``d**2 = t*t*|a|**2 + M*M - 2*t*score`` with t the anchor's scale. Each row is assigned to the nearest of
some pivots, its Voronoi cell, at distance r. Anchors near each other, cell by cell, form groups of about ``ANCHORS``.

An anchor at distance d from a cell's pivot can need a row at r only if ``|d - r|`` is at most the distance up to which it looks, and ``d + r`` at least that
from which on. Over a group that is a range of r for each cell, and a candidate is sent to the groups whose range holds it. For positives the distance is bounded by the
cells' least r of the anchor's label; for negatives it follows from the positives' scores. Groups and parts of cells (``ROWS`` rows, hot cells split) meet, and
each such pair is joined exactly, by one product of integer matrices; what leaves it are the best few of each anchor. Ranks of pairs are merged by a window.

Where no pivot is near, as with random directions in many dimensions, the ranges hold everything, and all rows meet all groups, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import exchange as X

ANCHORS, ROWS = 1024, 32_768  # about so many anchors a group, rows a part of a cell
PIVOTS = 256  # at most; a table of pivots stays under 8 MB
EXACT = 1 << 53
MATCHES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
ARROW_MATCHES = pa.schema([(x.split()[0], pa.int64()) for x in MATCHES.split(", ")])


def scaled(vector: str | Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component x, as a double; null where any component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    right = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(right, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column; a shorter one is extended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    out = np.zeros((n, dim), dtype)
    if n:
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        width = np.diff(offsets)
        row = np.repeat(np.arange(n), width)
        out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], width)] = values
    return out


class Space:
    """The sphere of augmented vectors and its pivots."""

    def __init__(self, dim: int, norm2: int, pivots: np.ndarray):
        self.dim, self.m2 = dim, float(norm2)
        self.pivots = np.hstack([pivots, np.sqrt(np.maximum(self.m2 - (pivots**2).sum(1), 0))[:, None]]) if len(pivots) else np.zeros((0, dim + 1))

    def scale(self, norm2: np.ndarray) -> np.ndarray:
        return np.divide(np.sqrt(self.m2), np.sqrt(norm2), out=np.zeros(len(norm2)), where=norm2 > 0)

    def distances(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        """From each row to each pivot."""
        norm2 = (v**2).sum(1)
        last = np.zeros(len(v)) if anchors else np.sqrt(np.maximum(self.m2 - norm2, 0))
        at = np.hstack([v * self.scale(norm2)[:, None] if anchors else v, last[:, None]])
        d2 = (at**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * at @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def reach(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which an anchor has a score."""
        t = self.scale(norm2)
        return np.sqrt(np.maximum(t * t * norm2 + self.m2 - 2 * t * score, 0))

    @property
    def slack(self) -> float:
        return 1e-6 * np.sqrt(self.m2) + 1e-9


def placed(rows: DataFrame, space: Space, anchors: bool = False) -> DataFrame:
    """Rows (id, label, v, cell, r), of anchors also ``away``, the distances to all pivots."""
    more = ", away array<double>" if anchors else ""

    def run(batches):
        for batch in batches:
            away = space.distances(matrix(batch.column("v"), space.dim), anchors)
            cell = away.argmin(1)
            columns = [batch.column("id"), batch.column("label"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])]
            names = ["id", "label", "v", "cell", "r"]
            if anchors:
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(away) + 1) * away.shape[1], pa.int32()), pa.array(away.ravel())))
                names.append("away")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label int, v array<long>, cell int, r double" + more)


def chain(pivots: np.ndarray) -> list[int]:
    """Pivots in an order in which each is followed by the nearest that is left."""
    if not len(pivots):
        return []
    left, order = set(range(1, len(pivots))), [0]
    while left:
        rest = np.array(sorted(left))
        order.append(int(rest[((pivots[rest] - pivots[order[-1]]) ** 2).sum(1).argmin()]))
        left.discard(order[-1])
    return order


def dealt(counts: dict[int, int], order: list[int], size: int) -> list[tuple[int, int, int]]:
    """(cell, first, splits): neighbouring cells share a share of about ``size`` rows, a larger cell has shares of its own."""
    out, share, filled = [], 0, 0
    for cell in order:
        n = counts.get(cell, 0)
        if filled and filled + n > size:
            share, filled = share + 1, 0
        splits = max(1, -(-n // size))
        out.append((cell, share, splits))
        filled += n
        if splits > 1:
            share, filled = share + splits, 0
    return out


def best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k places of ``at`` with the highest scores, ties by the smaller id."""
    if len(at) > k:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < EXACT else a @ b.T


class Join:
    """Anchors and rows of one space, met group by part."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, space: Space):
        self.spark: SparkSession = rows.sparkSession
        self.space = space
        self.rows = X.written(placed(rows, space), "cells")
        self.anchors = X.written(placed(anchors, space, True), "anchors")
        order = chain(space.pivots)
        told = lambda df: df.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()  # noqa: E731  one row a pivot
        cells = told(self.rows)
        self.inner, self.outer = np.full(len(order), np.inf), np.full(len(order), -np.inf)
        for c in cells:
            self.inner[c.cell], self.outer[c.cell] = c.low, c.high
        self.parts = self._shares(dealt({c.cell: c.n for c in cells}, order, ROWS), "part")
        self.groups = self._shares(dealt({c.cell: c.n for c in told(self.anchors)}, order, ANCHORS), "grp")
        self.rows = self._dealt(self.rows, self.parts, "part")
        self.anchors = self._dealt(self.anchors, self.groups, "grp")

    def _shares(self, shares: list[tuple[int, int, int]], name: str) -> DataFrame:
        return self.spark.createDataFrame(shares, f"cell int, first_{name} int, splits_{name} int")

    def _dealt(self, rows: DataFrame, shares: DataFrame, name: str) -> DataFrame:
        own = F.col(f"first_{name}") + F.pmod(F.xxhash64("id"), F.col(f"splits_{name}")).cast("int")
        return rows.join(F.broadcast(shares), "cell").withColumn(name, own).drop(f"first_{name}", f"splits_{name}")

    def bounds(self, anchors: DataFrame, by_label: bool) -> DataFrame:
        """For groups of anchors with ``near, far``, the range of r of each cell that can serve them: (grp, [label,] cell, low, high)."""
        label = ["label"] if by_label else []
        schema = "grp int, " + "label int, " * by_label + "cell int, low double, high double"
        slack, inner, outer = self.space.slack, self.inner, self.outer

        def run(table: pa.Table) -> pa.Table:
            n = table.num_rows
            away = np.asarray(table.column("away").combine_chunks().values).reshape(n, -1)
            near, far = (table.column(c).to_numpy()[:, None] for c in ("near", "far"))
            low = np.maximum((away - far).min(0), (near - away).min(0)) - slack
            high = (away + far).max(0) + slack
            cell = np.arange(away.shape[1])
            first = {c: pa.array([table.column(c)[0].as_py()] * len(cell), pa.int32()) for c in ["grp", *label]}
            out = pa.table(first | {"cell": pa.array(cell, pa.int32()), "low": low, "high": high})
            return out.filter(pa.array((low <= outer) & (high >= inner) & (low <= high)))  # cells that hold rows of the range

        return anchors.select("grp", *label, "away", "near", "far").groupBy("grp", *label).applyInArrow(run, schema)

    def met(self, anchors: DataFrame, by_label: bool, local, schema: str) -> DataFrame:
        """Send candidates to the groups they might serve, and join each group with each part."""
        label = ["label"] if by_label else []
        every = F.sequence(F.col("first_part"), F.col("first_part") + F.col("splits_part") - 1)
        bounds = X.written(self.bounds(anchors, by_label), "bounds").join(F.broadcast(self.parts), "cell").withColumn("part", F.explode(every))
        sent = self.rows.join(bounds.select("grp", *label, "cell", "part", "low", "high"), [*label, "cell", "part"]).where(F.col("r").between(F.col("low"), F.col("high")))
        pairs = bounds.select("grp", "part").distinct()
        left = anchors.drop("away", "cell", "r", "near", "far").join(pairs, "grp")
        return left.groupBy("grp", "part").cogroup(sent.select("grp", "part", "id", "label", "v").groupBy("grp", "part")).applyInArrow(local, schema)


def scores(left: pa.Table, right: pa.Table, dim: int, block: int = 64):
    """For each anchor: its place, and its scores with all candidates."""
    a, c = matrix(left.column("v"), dim, np.int64), matrix(right.column("v"), dim, np.int64)
    for s in range(0, len(a), block):
        for k, row in enumerate(products(a[s : s + block], c)):
            yield s + k, row


def nearest_of_label(join: Join, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's k best other rows of its label."""
    dim = join.space.dim
    ranked = join.rows.select("label", "cell", "r").withColumn("n", F.row_number().over(Window.partitionBy("label", "cell").orderBy("r"))).where(F.col("n") <= k + 1)
    least = ranked.groupBy("label").agg(F.collect_list(F.struct("cell", "r")).alias("least"))  # k + 1 for each pivot at most
    away = F.array_sort(F.transform("least", lambda x: F.element_at("away", x["cell"] + 1) + x["r"]))
    far = F.when(F.size("least") > k, F.element_at(away, k + 1)).otherwise(F.lit(float("inf")))
    anchors = join.anchors.join(least, "label").withColumn("far", far).withColumn("near", F.lit(0.0)).drop("least")

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()
            own, own_label = left.column("id").to_numpy(), left.column("label").to_numpy()
            for i, score in scores(left, right, dim):
                at = best(score, ids, np.flatnonzero((labels == own_label[i]) & (ids != own[i])), k)
                found.extend(zip([own[i]] * len(at), ids[at], score[at], strict=True))
        return pa.table({c: pa.array([r[j] for r in found], pa.int64()) for j, c in enumerate(("anchor_id", "positive_id", "positive_score"))})

    found = join.met(anchors, True, local, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def negatives_of(join: Join, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from positives of join's anchors."""
    space = join.space
    own = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    anchors = join.anchors.join(own.withColumnRenamed("anchor_id", "id"), "id")

    def ranged(batches):
        for batch in batches:
            pos = batch.column("positives")
            at = pos.offsets.to_numpy()
            score = pos.values.field("positive_score").to_numpy()[at[0] : at[-1]].astype(np.float64)
            at = at[:-1] - at[0]
            norm2 = (matrix(batch.column("v"), space.dim) ** 2).sum(1)
            far = space.reach(norm2, np.minimum.reduceat(np.where(score < 0, np.inf, low * score / 100), at))
            near = space.reach(norm2, np.maximum.reduceat(high * score / 100, at))
            some = np.maximum.reduceat(score, at) >= 0  # below 0 no score can lie in the range
            columns = {c: batch.column(c) for c in batch.schema.names} | {"near": pa.array(near), "far": pa.array(far)}
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(some))

    schema = T.StructType([*anchors.schema.fields, T.StructField("near", T.DoubleType()), T.StructField("far", T.DoubleType())])
    anchors = X.written(anchors.mapInArrow(ranged, schema), "ranged")

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()
            own, own_label, positives = left.column("id").to_numpy(), left.column("label").to_numpy(), left.column("positives").to_pylist()
            for i, score in scores(left, right, space.dim):
                other = labels != own_label[i]
                for p in positives[i]:
                    s = p["positive_score"]
                    at = best(score, ids, np.flatnonzero(other & (100 * score <= high * s) & (100 * score >= low * s)), k)
                    found.extend(zip([own[i]] * len(at), [p["positive_id"]] * len(at), [s] * len(at), ids[at], score[at], strict=True))
        return pa.table({c: pa.array([r[j] for r in found], pa.int64()) for j, c in enumerate(ARROW_MATCHES.names)})

    found = join.met(anchors, False, local, MATCHES)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int | None = None) -> DataFrame:
    """For each anchor and each of its first positives, its hardest negatives within low to high percent of the positive's score.

    rows: id long, label int, v array<long>; is_anchor: of these columns. Rows with a null id, label or v take no part; of rows with one
    id, the one with the least label and v does. A shorter v counts as extended by zeros. Scores are 64-bit integers; they are exact while they fit.
    pivots: so many rows, by a hash of their id, are the cells' centres; a quarter of the root of all rows, 8 at least and PIVOTS at most, if not given.
    Equal scores go by the smaller id. A positive with a score below 0 has no negatives: no score lies between it and a part of it.
    """
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("int"), "v").where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = X.written(rows, "vectors")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = X.written(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "vectors")
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm2)).first()
    many = pivots or min(PIVOTS, max(8, round((n or 0) ** 0.5 / 4)), max(1, (1 << 20) // max(1, dim or 1)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(many).select("v").toArrow()
    space = Space(dim or 1, top or 0, matrix(chosen.column("v"), dim or 1))
    anchors = rows.where(is_anchor)
    if not len(space.pivots):
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    join = Join(rows, anchors, space)
    first = X.written(nearest_of_label(join, positives), "positives")
    return negatives_of(join, first, negatives, low, high)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), scaled("embedding").alias("v"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP12_SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS a, r.id AS r, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.id % 100 = 0 AND a.id <> r.id),
positives AS (SELECT a, r AS p, score AS ps FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, r) <= 5)
SELECT a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY a, p ORDER BY score DESC, r)::INT AS rank, r AS negative_id, ps AS positive_score, score AS negative_score
FROM positives JOIN pairs USING (a)
WHERE NOT same AND 80 * ps <= 100 * score AND 100 * score <= 100 * ps
QUALIFY rank <= 5
"""
