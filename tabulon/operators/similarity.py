"""Hamming joins of 64-bit hashes, and order-stable greedy removal of near copies.

Joins run on distinct hashes.  For small distances one side's bands are probed with small flips, and the other's looked up as they are: at 4
bits a hash has 20 probes, of which chance meets one other in three thousand.  Where chance would meet more than one in a hundred (from 12 bits
on), all pairs of blocks of bounded size are compared instead, as arrays: the pairs are as many as before or more, but none is a row unless it is near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bands, hamming, probe_share, probes

#: Hashes of a block, about; the share of all values probed from which on blocks are compared; tasks at most; pairs that are handed on at once.
BLOCK, DENSE, TASKS, BATCH = 8192, 0.01, 1000, 1 << 18
#: Hashes of the left block that are held against the right one at once.
_STRIP = 16


def _near(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Pairs (x, y) of distinct hashes of both sides within the distance."""
    l, r = (side.select("bits").where("bits is not null").distinct() for side in (left, right))
    if probe_share(distance) > DENSE:
        return _compared(l, r, distance)
    asked = l.select(F.col("bits").alias("x"), F.explode(probes(F.col("bits"), distance)).alias("b")).select("x", "b.band", "b.value")
    held = r.select(F.col("bits").alias("y"), F.explode(bands(F.col("bits"))).alias("b")).select("y", "b.band", "b.value")
    return asked.join(held, ["band", "value"]).where(hamming(F.col("x"), F.col("y")) <= distance).select("x", "y").distinct()


def _near_within(rows: DataFrame, distance: int) -> DataFrame:
    """Pairs (x, y) of the distinct hashes of ``rows`` within the distance, each pair once, either way round, and none of a hash with itself."""
    if probe_share(distance) > DENSE:
        return _compared(rows.select("bits").where("bits is not null").distinct(), None, distance)
    return _near(rows, rows, distance).where("x < y")


def _compared(left: DataFrame, right: DataFrame | None, distance: int) -> DataFrame:
    """All pairs (x, y) of different hashes (bits) of both sides, or of one, within the distance.

    Hashes are dealt to blocks by a hash of their own.  A block is one row; it is sent once to each block of the other side, and each pair of
    blocks is compared on its own.
    """
    n = left.count() // BLOCK + 1
    m = n if right is None else right.count() // BLOCK + 1
    a, b = _blocks(left, n), _blocks(left if right is None else right, m)
    to = lambda first, last: F.explode(F.sequence(first, last))
    low = a.select(F.col("block").alias("low"), to(F.col("block") if right is None else F.lit(0), F.lit(m - 1)).alias("high"), F.col("held").alias("l"), F.lit(None).cast("array<bigint>").alias("r"))
    high = b.select(to(F.lit(0), F.col("block") if right is None else F.lit(n - 1)).alias("low"), F.col("block").alias("high"), F.lit(None).cast("array<bigint>").alias("l"), F.col("held").alias("r"))
    count = n * (n + 1) // 2 if right is None else n * m
    # A join would be free to broadcast a side; the number of tasks is given, as the work isn't in the bytes.
    dealt = low.unionByName(high).repartition(min(count, TASKS), "low", "high")
    pairs = dealt.groupBy("low", "high").agg(F.first("l", True).alias("l"), F.first("r", True).alias("r")).where("l is not null and r is not null")
    return pairs.select((F.lit(right is None) & (F.col("low") == F.col("high"))).alias("own"), "l", "r").mapInArrow(_comparer(distance), "x long, y long")


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    return rows.groupBy(F.pmod(F.xxhash64("bits"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list("bits").alias("held"))


def _comparer(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, left, right = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                yield from _pairs(left[k].values.to_numpy(), right[k].values.to_numpy(), distance, own[k])

    return compare


def _pairs(a: np.ndarray, b: np.ndarray, distance: int, own: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of two arrays of hashes within the distance; of one array with itself (``own``) each pair once."""
    xs, ys, found = [], [], 0
    for i in range(0, len(a), _STRIP):
        strip, rest = a[i : i + _STRIP], b[i:] if own else b
        near = np.bitwise_count((strip[:, None] ^ rest[None, :]).view(np.uint64)) <= distance
        if not near.any():
            continue
        r, c = np.nonzero(near)
        if own:
            r, c = r[c > r], c[c > r]
        xs.append(strip[r])
        ys.append(rest[c])
        found += len(r)
        if found >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])
            xs, ys, found = [], [], 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])


def hamming_pairs(left: DataFrame, right: DataFrame, *, distance: int = 4) -> DataFrame:
    """Pairs (l, r) of (id, bits) rows within a Hamming distance."""
    l, r = left.select(F.col("id").alias("l"), F.col("bits").alias("x")), right.select(F.col("id").alias("r"), F.col("bits").alias("y"))
    return l.join(_near(left, right, distance), "x").join(r, "y").select("l", "r", hamming(F.col("x"), F.col("y")).alias("distance"))


def near_any(rows: DataFrame, reference: DataFrame, *, distance: int = 4) -> DataFrame:
    """Ids of rows that are within the distance of any reference hash; each row comes once, however many there are."""
    hit = _near(reference, rows, distance).select(F.col("y").alias("bits")).distinct()
    return rows.join(hit, "bits", "left_semi").select("id")


def first_near(rows: DataFrame, reference: DataFrame, *, distance: int = 4) -> DataFrame:
    """id, name: for each row that is near a reference (name, ord, bits), the name of the first one in order."""
    named = reference.where("bits is not null").groupBy(F.col("bits").alias("x")).agg(F.min(F.struct("ord", "name")).alias("first"))
    best = _near(reference, rows, distance).join(named, "x").groupBy(F.col("y").alias("bits")).agg(F.min("first").alias("first"))
    return rows.join(best, "bits").select("id", F.col("first.name").alias("name"))


def greedy_keep(nodes: DataFrame, edges: DataFrame, *, group: str | None = None) -> DataFrame:
    """Goes through nodes (id) in order and keeps each that no kept neighbour precedes; a dropped node suppresses
    nothing.  Rows of one ``group`` (null: of none) are neighbours too, without an edge for each pair.  Adds ``kept``.

    Solved by rounds: a node is kept once all earlier neighbours are dropped, and dropped once one is kept.  Only edges whose ends are both
    open go on to the next round.
    """
    state = nodes.select("id", (F.col(group) if group else F.lit(None).cast("string")).alias("g")).dropDuplicates(["id"]).withColumn("kept", F.lit(None).cast("boolean"))
    back = edges.select(F.greatest("l", "r").alias("id"), F.least("l", "r").alias("before")).where("id <> before").distinct().checkpoint()
    while True:
        seen = back.join(state.select(F.col("id").alias("before"), F.col("kept").alias("was")), "before")
        told = seen.groupBy("id").agg(F.bool_or(F.coalesce("was", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("was"), F.lit(False))).alias("clear"))
        state = state.join(told, "id", "left")
        if group:
            lead = state.where("g is not null").groupBy("g").agg(F.min(F.when(F.coalesce("kept", F.lit(True)), F.col("id"))).alias("open"), F.min(F.when(F.col("kept"), F.col("id"))).alias("taken"))
            state = state.join(lead, "g", "left")
        else:
            state = state.withColumn("open", F.lit(None)).withColumn("taken", F.lit(None))
        hit = F.coalesce(F.col("hit"), F.lit(False)) | F.coalesce(F.col("taken") < F.col("id"), F.lit(False))
        clear = F.coalesce(F.col("clear"), F.lit(True)) & F.coalesce(F.col("open") == F.col("id"), F.lit(True))
        state = state.select("id", "g", F.coalesce("kept", F.when(hit, F.lit(False)).when(clear, F.lit(True))).alias("kept")).checkpoint()
        if state.where("kept is null").isEmpty():
            return state.drop("g")
        back = seen.where("was is null").select("id", "before").join(state.where("kept is null").select("id"), "id", "left_semi").checkpoint()


def keep_distinct(rows: DataFrame, *, distance: int, group: str | None = None) -> DataFrame:
    """id, kept: greedy removal of near copies of (id, bits) rows.  Of equal hashes only the first can stay, so one row stands for each
    and copies don't multiply the pairs."""
    columns = ["id", "bits"] + ([group] if group else [])
    first = rows.where("bits is not null").groupBy("bits").agg(F.min("id").alias("id")).checkpoint()
    if group:
        # Rows of a group meet each other by it, whatever their hashes: they all take part, copies as neighbours of the first.
        copies = rows.where("bits is not null").join(first.select("bits", F.col("id").alias("l")), "bits").where("id <> l").select("l", F.col("id").alias("r"), "bits")
        pairs = hamming_pairs(rows.select("id", "bits"), rows.select("id", "bits"), distance=distance).where("l < r").select("l", "r")
        return greedy_keep(rows.select(*columns), pairs.unionByName(copies.select("l", "r")), group=group)
    of = lambda end, name: first.select(F.col("bits").alias(end), F.col("id").alias(name))
    pairs = _near_within(first, distance).join(of("x", "l"), "x").join(of("y", "r"), "y").select("l", "r")
    kept = greedy_keep(first, pairs).where("kept").select("id", "kept")
    return rows.select("id", "bits").join(kept, "id", "left").select("id", F.coalesce("kept", F.col("bits").isNull()).alias("kept"))


def exclude_evaluation(images: DataFrame, evaluation: DataFrame, *, distance: int = 4) -> DataFrame:
    """Why each image (id, photo, bits) goes, or null: its photo is one of the evaluation's, its hash is near one of them, or
    it is a near copy of an image that is kept before it, or of the same photo.  Images go in the order of their ids; for another
    priority let the id be a struct that begins with it."""
    by_photo = images.join(evaluation.select("photo").where("photo is not null").distinct(), "photo", "left_semi").select("id", F.lit("photo").alias("cause"))
    left = images.join(by_photo, "id", "left_anti")
    by_hash = near_any(left.select("id", "bits"), evaluation.select("bits"), distance=distance).select("id", F.lit("near").alias("cause"))
    rest = left.join(by_hash, "id", "left_anti").checkpoint()
    twins = keep_distinct(rest, distance=distance, group="photo").where("not kept").select("id", F.lit("twin").alias("cause"))
    return images.join(by_photo.unionByName(by_hash).unionByName(twins), "id", "left")
