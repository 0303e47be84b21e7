"""Hard-negative mining by a Voronoi-partitioned kNN join on inner products.

Inner products become distances by one more component: with M the largest norm, rows are (x, sqrt(M^2 - |x|^2)) and anchors (q, 0), so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x and the largest products are the nearest rows.  Rows go to the nearest of a few pivots.  Anchors of one cell
make a group, whose radius and the summary of the rows' cells bound how far its answers can lie:

- a positive (the k nearest rows of the same label) lies within the k-th smallest of radius + distance of pivots + distance of a row to
  its pivot, over the k smallest of these in each cell;
- a negative's product lies between shares of its positive's, so its distance lies in a window, once the positives are known.

By the triangle inequality a row is sent to a group only if its distance to its own pivot lets it meet that bound.  Groups and rows are cut into blocks of
bounded size; a pair of blocks is joined exactly, in whole numbers, and sends the best of its rows for each anchor; these are merged by anchor.
Only pivots and figures of cells, both of fixed number, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import prepare

SCALE = 256
#: Pivots: one for so many anchors, within bounds.
PER_PIVOT, LEAST, MOST = 1024, 8, 256
#: Rows and anchors of a block.
ROWS, ANCHORS = 32_768, 1_024
#: Distances are rounded; a bound gives way by this share, so that nothing is lost to it.
SLACK = 1e-6


def prepared_rows(rows: DataFrame) -> DataFrame:
    """vec_id, label, v: rows that take part, their components floor(256 x) as whole numbers, the label of each seventh moved on by one."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int")).alias("v"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Whole numbers of packed vectors, shorter ones filled up with zeros."""
    packed = vectors.to_pylist()
    if all(len(b) == 4 * width for b in packed):
        return np.frombuffer(b"".join(packed), np.int32).reshape(len(packed), width).astype(float)
    out = np.zeros((len(packed), width))
    for i, b in enumerate(packed):
        v = np.frombuffer(b, np.int32)
        out[i, : len(v)] = v
    return out


def _largest(s: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k largest of ``s`` among ``at``, larger first; equal ones in their order."""
    if len(at) > 4 * k:
        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-s[at], kind="stable")[:k]]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by floating point where every sum stays below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


class _Space:
    """Pivots (with their further component) and what distances are measured by; of fixed size."""

    def __init__(self, pivots: np.ndarray, width: int, square: int):
        self.width, self.square = width, square
        self.points = np.hstack([pivots, np.sqrt(np.maximum(square - (pivots**2).sum(axis=1), 0))[:, None]])
        d = self.points[:, None, :] - self.points[None, :, :]
        self.apart = np.sqrt((d**2).sum(axis=2))

    def nearest(self, x: np.ndarray, anchors: bool) -> tuple[np.ndarray, np.ndarray]:
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.square - (x**2).sum(axis=1), 0))
        full = np.hstack([x, last[:, None]])
        d = (full**2).sum(axis=1)[:, None] - 2 * full @ self.points.T + (self.points**2).sum(axis=1)[None, :]
        cell = d.argmin(axis=1)
        return cell, np.sqrt(np.maximum(((full - self.points[cell]) ** 2).sum(axis=1), 0))


def _assigned(rows: DataFrame, space: _Space, anchors: bool) -> DataFrame:
    """vec_id, label, cell, dist (to the cell's pivot), square (of the norm), v (packed)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()]))
            packed = pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            x = _matrix(packed, space.width)
            cell, dist = space.nearest(x, anchors)
            values = [batch.column("vec_id"), batch.column("label"), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array((x**2).sum(axis=1)), packed]
            yield pa.RecordBatch.from_arrays(values, names=["vec_id", "label", "cell", "dist", "square", "v"])

    return rows.mapInArrow(assign, "vec_id long, label long, cell int, dist double, square double, v binary")


def _joined(sent: DataFrame, anchors: DataFrame, space: _Space, best, out: str) -> DataFrame:
    """Pairs of blocks that meet: ``sent`` has the rows with ``group`` (the anchors' cell), and ``cell``, ``block`` of the rows;
    ``best(anchors, matrix of anchors, rows, matrix of rows)`` gives a pair's result."""
    meets = sent.select(*[F.col(c).alias(c) for c in ("group", "cell", "block")]).distinct()
    left = anchors.withColumnRenamed("cell", "group").drop("dist", "square").join(meets, "group")
    shares = anchors.groupBy(F.col("cell").alias("group")).agg(F.max("part").alias("parts"))
    # Each row goes once to each block of the group's anchors.
    right = sent.join(F.broadcast(shares), "group").select("*", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("part"))
    keys = ["group", "cell", "block", "part"]

    def meet(a: pa.Table, r: pa.Table) -> pa.Table:
        a, r = a.combine_chunks(), r.combine_chunks()
        if not a.num_rows or not r.num_rows:
            return best.empty()
        return best(a, _matrix(a.column("v"), space.width), r, _matrix(r.column("v"), space.width))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out)


class _Positives:
    """The first k other rows of the same label for each anchor, of a pair of blocks."""

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def __init__(self, k: int):
        self.k = k

    def empty(self) -> pa.Table:
        return self.schema.empty_table()

    def __call__(self, a: pa.Table, am: np.ndarray, r: pa.Table, rm: np.ndarray) -> pa.Table:
        ids, labels, aid, al = (t.column(c).to_numpy() for t, c in ((r, "vec_id"), (r, "label"), (a, "vec_id"), (a, "label")))
        found = []
        for label in np.unique(al):
            mine, theirs = np.flatnonzero(al == label), np.flatnonzero(labels == label)
            theirs = theirs[np.argsort(ids[theirs], kind="stable")]
            for low in range(0, len(mine), 64):
                at = mine[low : low + 64]
                for i, s in zip(at, _products(am[at], rm[theirs]), strict=True):
                    found += [(aid[i], ids[theirs[j]], s[j]) for j in _largest(s, np.flatnonzero(ids[theirs] != aid[i]), self.k)]
        return pa.Table.from_arrays([pa.array([int(f[c]) for f in found], pa.int64()) for c in range(3)], schema=self.schema)


class _Negatives:
    """The first k rows of another label in the window of each of an anchor's positives, of a pair of blocks.  Anchors have ``wanted``: structs of
    positive_id, place and score."""

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("place", pa.int32()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high

    def empty(self) -> pa.Table:
        return self.schema.empty_table()

    def __call__(self, a: pa.Table, am: np.ndarray, r: pa.Table, rm: np.ndarray) -> pa.Table:
        order = np.argsort(r.column("vec_id").to_numpy(), kind="stable")
        ids, labels, rm = r.column("vec_id").to_numpy()[order], r.column("label").to_numpy()[order], rm[order]
        aid, al, wanted = a.column("vec_id").to_numpy(), a.column("label").to_numpy(), a.column("wanted").to_pylist()
        found = []
        for low in range(0, len(aid), 64):
            for i, s in zip(range(low, len(aid)), _products(am[low : low + 64], rm), strict=False):
                other = labels != al[i]
                for w in wanted[i]:
                    # Whole numbers on both sides: low * p <= 100 * s <= high * p.
                    least, most = -(-self.low * w["score"] // 100), self.high * w["score"] // 100
                    at = _largest(s, np.flatnonzero(other & (s >= least) & (s <= most)), self.k)
                    found += [(aid[i], w["positive_id"], w["place"], w["score"], ids[j], s[j]) for j in at]
        types = [f.type for f in self.schema]
        return pa.Table.from_arrays([pa.array([int(f[c]) for f in found], t) for c, t in enumerate(types)], schema=self.schema)


def _first(rows: DataFrame, by: list[str], order: list, k: int, name: str) -> DataFrame:
    """The first k rows of each group in order; of a large group no more leave a task."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, place).where(F.col(name) <= k)


def hard_negatives(embeddings: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, per_pivot: int = PER_PIVOT, block: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    Rows (vec_id, embedding, label) with a null id, label, vector or component, or one that isn't finite, take no part; other columns are ignored.
    Anchors are rows whose id ``every`` divides; an anchor's positives are its first rows of the same label (larger inner product first, then the smaller
    id), and for each the first rows of another label are returned whose product p satisfies low * positive <= 100 * p <= high * positive.
    Ids that repeat: every row may be found, and be returned, on its own, but an id makes one anchor (its smallest label and vector), for which no row of its own id
    counts.  Shorter vectors count as filled up with zeros.  Scores have to fit a long, and scaled components an int.  An empty table gives no rows.
    """
    spark = prepare(embeddings.sparkSession)
    rows = prepared_rows(embeddings)
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long"))
    is_anchor = F.col("vec_id") % every == 0
    known = rows.agg(F.coalesce(F.max(norm), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(is_anchor)).first()
    few = min(MOST, max(LEAST, -(-known[2] // per_pivot)))
    # Pivots: the rows of the smallest hashes, at most MOST of them.
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(few).select("v").collect()
    pivots = np.zeros((len(picked), known[1]))
    for i, p in enumerate(picked):
        pivots[i, : len(p.v)] = p.v
    space = _Space(np.unique(pivots, axis=0) if picked else np.zeros((1, 0)), known[1], known[0])
    # Distances are rounded: bounds give way by a little, so that nothing is lost to it.
    slack = SLACK * (1 + known[0] ** 0.5)

    held = _in_blocks(_assigned(rows, space, False).checkpoint(), "block", block)
    one = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    anchors = _in_blocks(_assigned(one, space, True).checkpoint(), "part", ANCHORS)
    apart = F.broadcast(spark.createDataFrame([(i, j, float(d)) for i, line in enumerate(space.apart) for j, d in enumerate(line)], "group int, cell int, apart double"))

    # Positives: the distance of the k-th (one more, as an anchor may be its own nearest row) is bounded for each group and label.
    near = _first(held.select("cell", "label", "dist"), ["cell", "label"], ["dist"], positives + 1, "k").drop("k")
    groups = anchors.groupBy(F.col("cell").alias("group"), "label").agg(F.max("dist").alias("reach"))
    far = groups.join(near, "label").join(apart, ["group", "cell"]).select("group", "label", "reach", (F.col("reach") + F.col("apart") + F.col("dist")).alias("d"))
    found = _first(far, ["group", "label"], ["d"], positives + 1, "k").groupBy("group", "label").agg(F.first("reach").alias("reach"), F.max("d").alias("d"), F.max("k").alias("k"))
    within = F.when(F.col("k") > positives, F.col("d")).otherwise(F.lit(float("inf"))) + F.col("reach") + slack
    gates = found.withColumn("within", within).join(apart, "group").select("group", "label", "cell", (F.col("apart") - F.col("within")).alias("least"), (F.col("apart") + F.col("within")).alias("most"))
    sent = held.join(gates, ["label", "cell"]).where(F.col("dist").between(F.col("least"), F.col("most"))).select("group", "cell", "block", "vec_id", "label", "v")
    pairs = _joined(sent, anchors, space, _Positives(positives), "anchor_id long, positive_id long, score long")
    chosen = _first(pairs, ["anchor_id"], [F.desc("score"), "positive_id"], positives, "place").checkpoint()

    # Negatives: windows of products are windows of distances.  That of a negative product is empty.
    wanted = chosen.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("wanted"), F.min("score").alias("_low"), F.max("score").alias("_high"))
    asked = anchors.join(wanted, "vec_id")
    distance = lambda p: F.sqrt(F.greatest(F.col("square") + float(known[0]) - 2 * p, F.lit(0.0)))
    windows = asked.groupBy(F.col("cell").alias("group")).agg(F.max("dist").alias("reach"), F.min(distance(F.col("_high") * (high / 100))).alias("from"), F.max(distance(F.col("_low") * (low / 100))).alias("to")).join(apart, "group")
    nearest = F.greatest(F.abs(F.col("dist") - F.col("apart")) - F.col("reach"), F.lit(0.0))
    serves = (nearest <= F.col("to") + slack) & (F.col("dist") + F.col("apart") + F.col("reach") >= F.col("from") - slack)
    sent = held.join(F.broadcast(windows), "cell").where(serves).select("group", "cell", "block", "vec_id", "label", "v")
    pairs = _joined(sent, asked.drop("_low", "_high"), space, _Negatives(negatives, low, high), "anchor_id long, positive_id long, place int, positive_score long, negative_id long, negative_score long")
    best = _first(pairs, ["anchor_id", "place"], [F.desc("negative_score"), "negative_id"], negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("place").alias("positive_rank"))


def _in_blocks(rows: DataFrame, name: str, most: int) -> DataFrame:
    """Adds the block of each row within its cell; a cell has as many as its rows need, and cells are of fixed number."""
    sizes = {r["cell"]: -(-r["n"] // most) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("cell")) if sizes else F.lit(1)
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int"))
