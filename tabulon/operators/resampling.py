"""Bootstraps of grouped items whose resamples no task draws alone.

A resample of n units is a vector of multinomial counts.  Units are numbered and cut into blocks, and the counts of blocks follow from a tree: a node's count is split
binomially between its halves, by a generator that the seed, the group and the node give.  Every task finds the count of its own blocks by walking down the tree, and
draws the counts of their units; all repeats go at once.  So a group may have any number of units, and a resample is the same for any partitioning.

Where an AUROC is resampled, items carry their unit's counts, and are summed by ranges of the score.  Resamples without both classes are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running

BLOCK, SLAB, ITEMS = 512, 16, 4096


def _block_counts(seed: int, group: int, n: int, block: int, size: int, repeats: int) -> np.ndarray:
    """Counts (repeats, units) of a block of a group of n units."""
    low, high, node, count = 0, -(-n // size), 1, np.full(repeats, n)
    key = [seed, group & (2**64 - 1)]
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * size / (min(high * size, n) - low * size)
        left = np.random.default_rng([*key, node, 0]).binomial(count, share)
        if block < middle:
            high, count, node = middle, left, 2 * node
        else:
            low, count, node = middle, count - left, 2 * node + 1
    own = min((block + 1) * size, n) - block * size
    return np.random.default_rng([*key, node, 1]).multinomial(count, np.full(own, 1 / own))


def _numbered(units: DataFrame, by: list[str], unit: str, size: int) -> DataFrame:
    """Adds i (from 0 in its group), n (units of the group), a number for the group, and the slab of blocks that a task takes at once."""
    placed = running(units, by, [unit], {"_i": F.lit(1).cast("long")}).checkpoint()
    sizes = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("_n"))
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = placed.join(F.broadcast(sizes) if not by else sizes, match).drop(*[f"_{c}" for c in by])
    return joined.withColumns({"_group": F.xxhash64(*by) if by else F.lit(0).cast("long"), "_slab": F.floor(F.col("_i") / (size * SLAB))})


def _drawn(rows: DataFrame, by: list[str], use, out: str, repeats: int, seed: int, size: int) -> DataFrame:
    """``use(table of a block's units, counts)``, the first of whose columns (repeats + 1, units) is the sample itself, for each block."""

    def slab(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        t = t.take(pa.array(np.argsort(t.column("_i").to_numpy())))
        i, n, group = t.column("_i").to_numpy(), t.column("_n")[0].as_py(), t.column("_group")[0].as_py()
        parts = []
        for b in np.unique(i // size).tolist():
            own = t.filter(pa.array(i // size == b))
            parts.append(use(own, np.vstack([np.ones((1, own.num_rows), np.int64), _block_counts(seed, group, n, b, size, repeats)])))
        return pa.concat_tables(parts)

    return rows.groupBy(*by, "_slab").applyInArrow(slab, out)


def _keys(t: pa.Table, by: list[str], n: int) -> dict:
    return {c: pa.array([t.column(c)[0].as_py()] * n, t.schema.field(c).type) for c in by}


def _typed(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in names)


def _interval(values: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """by, name, low, high of a row for each resample, of which -1 is the sample itself."""
    rows = values.withColumn("_v", value)
    ends = F.percentile(F.when(F.col("_repeat") >= 0, F.col("_v")), F.array(F.lit(0.025), F.lit(0.975)))
    found = rows.groupBy(*by).agg(F.max(F.when(F.col("_repeat") < 0, F.col("_v"))).alias(name), ends.alias("_e"))
    return found.select(*by, name, F.get("_e", F.lit(0)).alias("low"), F.get("_e", F.lit(1)).alias("high"))


def resample_counts(units: DataFrame, by: list[str], unit: str, *, repeats: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """by, unit, counts: how often each of the distinct units is in the sample (once) and in each resample, as 32-bit numbers."""
    rows = units.select(*by, unit).distinct()

    def use(t: pa.Table, w: np.ndarray) -> pa.Table:
        return pa.table({**{c: t.column(c) for c in [*by, unit]}, "counts": pa.array([x.tobytes() for x in np.ascontiguousarray(w.T.astype(np.uint32))], pa.binary())})

    return _drawn(_numbered(rows, by, unit, block), by, use, f"{_typed(rows, [*by, unit])}, counts binary", repeats, seed, block)


def grouped_bootstrap(items: DataFrame, by: list[str], group: str, value: str, *, repeats: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """by, mean, and the 2.5 and 97.5 percentiles of means over resampled groups."""
    parts = items.groupBy(*by, group).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(value).cast("double").alias("_m"))

    def use(t: pa.Table, w: np.ndarray) -> pa.Table:
        s, m = np.nan_to_num(t.column("_s").to_numpy()), t.column("_m").to_numpy()
        return pa.table({**_keys(t, by, len(w)), "_repeat": pa.array(np.arange(-1, len(w) - 1), pa.int32()), "_s": w @ s, "_m": w @ m})

    drawn = _drawn(_numbered(parts, by, group, block), by, use, ", ".join(x for x in (_typed(items, by), "_repeat int, _s double, _m double") if x), repeats, seed, block)
    sums = drawn.groupBy(*by, "_repeat").agg(F.sum("_s").alias("_s"), F.sum("_m").alias("_m"))
    return _interval(sums, by, F.col("_s") / F.nullif(F.col("_m"), F.lit(0)), "mean")


def paired_bootstrap(items: DataFrame, by: list[str], group: str, a: str, b: str, **kw) -> DataFrame:
    """The same for the mean difference of two columns."""
    return grouped_bootstrap(items.withColumn("_d", F.col(a).cast("double") - F.col(b).cast("double")), by, group, "_d", **kw)


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds up the counts of equal rows (by, _x, _pos) of a batch, so that a score that very many items have is a few rows when it is dealt out."""
    names = [*by, "_x", "_pos"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.select(names).to_pandas().groupby(names, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            w = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint32).reshape(batch.num_rows, -1)[order]
            total = np.add.reduceat(w, first, axis=0, dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(order[first])).columns, pa.array([x.tobytes() for x in total], pa.binary())], names=[*names, "counts"])

    return rows.mapInArrow(merge, f"{_typed(rows, names)}, counts binary")


def _areas(items: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """by, _repeat, area of items that carry their unit's counts."""
    rows = items.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*by, F.col(score).cast("double").alias("_x"), F.col(positive).alias("_pos"), "counts")
    # Equal scores of a group lie in one range; ranges stay as they are from here on.
    ranged = _merged(rows, by).repartitionByRange(*by, "_x").withColumn("_part", F.spark_partition_id()).checkpoint()
    typed = lambda more: ", ".join(x for x in (_typed(items, by), more) if x)

    def weights(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint32).reshape(t.num_rows, -1)

    def below(t: pa.Table) -> pa.Table:
        w = weights(t)[~t.column("_pos").to_numpy()].sum(axis=0, dtype=np.int64)
        return pa.table({**_keys(t, by, len(w)), "_part": pa.array([t.column("_part")[0].as_py()] * len(w), pa.int32()), "_repeat": pa.array(np.arange(-1, len(w) - 1), pa.int32()), "_neg": w})

    before = Window.partitionBy(*by, "_repeat").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_part").applyInArrow(below, typed("_part int, _repeat int, _neg long")).withColumn("_below", F.coalesce(F.sum("_neg").over(before), F.lit(0)))

    def won(t: pa.Table, base: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        t = t.take(pa.array(np.argsort(t.column("_x").to_numpy(), kind="stable")))
        base = base.combine_chunks()
        under = base.column("_below").to_numpy()[np.argsort(base.column("_repeat").to_numpy())].astype(float)
        x, pos = t.column("_x").to_numpy(), t.column("_pos").to_numpy().astype(bool)
        wins, every, others = (np.zeros(len(under)) for _ in range(3))
        starts = np.append(np.flatnonzero(np.diff(x, prepend=np.nan) != 0), len(x))
        low = 0
        while low < len(starts) - 1:
            # Whole runs of equal scores, some thousands of items at a time.
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + ITEMS, "right")) - 1)
            a, b = starts[low], starts[high]
            w, own, cut = weights(t.slice(a, b - a)).astype(float), pos[a:b], starts[low:high] - a
            p, n = np.add.reduceat(w * own[:, None], cut, axis=0), np.add.reduceat(w * ~own[:, None], cut, axis=0)
            less = under + np.cumsum(n, axis=0) - n
            wins += (p * (less + n / 2)).sum(axis=0)
            every, others, under, low = every + p.sum(axis=0), others + n.sum(axis=0), under + n.sum(axis=0), high
        return pa.table({**_keys(t, by, len(wins)), "_repeat": pa.array(np.arange(-1, len(wins) - 1), pa.int32()), "_w": wins, "_p": every, "_q": others})

    keys = [*by, "_part"]
    parts = ranged.groupBy(*keys).cogroup(sums.select(*[F.col(c).alias(c) for c in [*keys, "_repeat", "_below"]]).groupBy(*keys)).applyInArrow(won, typed("_repeat int, _w double, _p double, _q double"))
    return parts.groupBy(*by, "_repeat").agg((F.sum("_w") / F.nullif(F.sum("_p") * F.sum("_q"), F.lit(0))).alias("area"))


def _counted(items: DataFrame, by: list[str], unit: str, kw: dict) -> DataFrame:
    counts = resample_counts(items, by, unit, **kw)
    match = F.lit(True)
    for c in [*by, unit]:
        match = match & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return items.alias("x").join(counts.alias("y"), match).select("x.*", "y.counts")


def auroc_bootstrap(pairs: DataFrame, by: list[str], pair: str, positive: str, negative: str, **kw) -> DataFrame:
    """by, auroc of positive against negative scores, and its interval from resampled pairs."""
    sides = F.explode(F.array(*[F.struct(F.col(c).cast("double").alias("score"), F.lit(c == positive).alias("pos")) for c in (positive, negative)]))
    items = pairs.select(*by, pair, sides.alias("_s")).select(*by, pair, "_s.score", "_s.pos")
    return _interval(_areas(_counted(items, by, pair, kw), by, "score", "pos"), by, F.col("area"), "auroc")


def auroc_difference(items: DataFrame, by: list[str], group: str, positive: str, a: str, b: str, **kw) -> DataFrame:
    """by, difference of the AUROC of two scores of the same items, and its interval from resampled groups, which are the same for both."""
    rows = _counted(items.select(*by, group, positive, a, b), by, group, kw).checkpoint()
    x, y = (_areas(rows, by, c, positive).alias(n) for c, n in ((a, "x"), (b, "y")))
    match = F.col("x._repeat") == F.col("y._repeat")
    for c in by:
        match = match & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = x.join(y, match).select(*[F.col(f"x.{c}") for c in by], "x._repeat", (F.col("x.area") - F.col("y.area")).alias("_d"))
    return _interval(both, by, F.col("_d"), "difference")
