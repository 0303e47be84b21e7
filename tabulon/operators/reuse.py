"""Reuse distances of a log: how many other keys were used since a key's last use.

A cache of the c most recently used keys has a key exactly if fewer than c others were used in between, so the distances answer every capacity at once.
With p the place of a row's previous use and i its own, the other keys in between are the places in between, less those whose own previous use lies in between
too, i.e. less the rows j < i with p < prev(j).  These pairs are counted as a merge sort would count them: two places differ first at one binary digit, which
puts them into the left and the right half of one node; within nodes of ``BLOCK`` places they are counted by numpy at once, and above by sums over ranges of the
previous places, so that neither a busy key nor a large node is one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running

BLOCK_BITS = 14


def _inner(places: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
    """For each row the number of rows before it whose previous use is later than its own; digit by digit, all nodes at once."""
    out = np.zeros(len(places), np.int64)
    for level in range(bits):
        node, right = places >> (level + 1), (places >> level & 1).astype(bool)
        order = np.lexsort((-before, node))
        left = np.cumsum(~right[order])
        first = np.flatnonzero(np.diff(node[order], prepend=-1))
        base = np.repeat(left[first] - ~right[order][first], np.diff(np.append(first, len(order))))
        found = np.where(right[order], left - base, 0)
        out[order] += found
    return out


def _counted(uses: DataFrame, bits: int) -> DataFrame:
    """i, inner of uses (i, p)."""

    def block(t: pa.Table) -> pa.Table:
        i, p = t.column("i").to_numpy(), t.column("p").to_numpy()
        return pa.table({"i": i, "inner": _inner(i, p, bits)})

    within = uses.withColumn("block", F.shiftright("i", bits)).groupBy("block").applyInArrow(block, "i long, inner long")
    last = uses.agg(F.max("i")).first()[0]
    levels = range(bits, max(bits, int(last or 0).bit_length()))
    if not levels:
        return within
    each = F.explode(F.array(*[F.lit(x) for x in levels]))
    digits = uses.withColumn("level", each).select("level", F.expr("shiftright(i, level + 1)").alias("node"), F.expr("shiftright(i, level) & 1").alias("side"), "i", (-F.col("p")).alias("later"))
    above = running(digits, ["level", "node"], ["later"], {"inner": (F.col("side") == 0).cast("long")}).where("side = 1").select("i", "inner")
    return within.unionByName(above).groupBy("i").agg(F.sum("inner").alias("inner"))


def reuse_distances(requests: DataFrame, *, key: str = "key", order: str = "ord", block_bits: int = BLOCK_BITS) -> DataFrame:
    """Adds ``distance``: the number of different other keys since the key's last use, null at its first.  ``order`` has to be total; a null key is one like
    any other."""
    placed = running(requests.select(F.col(order).alias("_o"), F.col(key).alias("_k")), [], ["_o"], {"i": F.lit(1).cast("long")}).checkpoint()
    # A key's uses are numbered, and each meets the one before it: no task holds all uses of a key.
    nth = running(placed, ["_k"], ["i"], {"n": F.lit(1).cast("long")}).select("_o", "_k", "i", "n").checkpoint()
    before = nth.select(F.col("_k").alias("_bk"), (F.col("n") + 1).alias("_bn"), F.col("i").alias("p"))
    uses = nth.join(before, F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("n") == F.col("_bn"))).select("_o", "i", "p").checkpoint()
    found = uses.join(_counted(uses.select("i", "p"), block_bits), "i").select("_o", (F.col("i") - F.col("p") - 1 - F.col("inner")).alias("distance"))
    return requests.join(found, requests[order] == found["_o"], "left").drop("_o")


def cache_hits(requests: DataFrame, *, key: str = "key", order: str = "ord", capacity: int = 64, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Adds ``hit``: is the key among the ``capacity`` most recently used ones?"""
    rows = reuse_distances(requests, key=key, order=order, block_bits=block_bits)
    return rows.withColumn("hit", F.coalesce(F.col("distance") < capacity, F.lit(False))).drop("distance")


def hit_curve(distances: DataFrame, by: list[str]) -> DataFrame:
    """by, capacity, hits: how many requests a cache of each capacity would have served; of capacities that serve no more than the next smaller one only that is
    listed."""
    counts = distances.where("distance IS NOT NULL").groupBy(*by, (F.col("distance") + 1).alias("capacity")).agg(F.count("*").alias("n"))
    return running(counts, by, ["capacity"], {"_less": F.col("n")}).select(*by, "capacity", (F.col("_less") + F.col("n")).alias("hits"))
