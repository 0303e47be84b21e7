"""Metrics of groups of scored items.  Rows have p and y (arrays), and whatever columns they are grouped by."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as pr
from .ranking import counted, running

BINS = 15


def accuracy(p: Column, y: Column) -> Column:
    return F.avg((pr.first_max(p) == pr.first_max(y)).cast("double"))


def accuracy_without_ties(p: Column, y: Column) -> Column:
    gold = pr.majority(y)
    return F.avg(F.when(gold.isNotNull(), (pr.first_max(p) == gold).cast("double")))


def calibration_error(items: DataFrame, by: list[str], *, confidence: str = "conf", correct: str = "correct", bins: int = BINS) -> DataFrame:
    """Expected calibration error over equal bins; a confidence on an edge belongs to the upper bin."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    binned = items.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col(confidence))))
    parts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(correct).alias("a"))
    return parts.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def auroc(items: DataFrame, by: list[str], *, score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the ROC curve with ties counted half; NaN where a class is missing.

    Counts per distinct score come first; how many negatives lie below each is summed by ranges of scores.
    """
    counts = items.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.sum((~F.col(positive)).cast("long")).alias("neg"))
    ranked = running(counts, by, [score], {"below": F.col("neg")}).withColumn("won", F.col("pos") * (F.col("below") + 0.5 * F.col("neg")))
    return ranked.groupBy(*by).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).otherwise(F.lit(float("nan"))).alias("auroc"))


def risk_coverage(items: DataFrame, by: list[str], order: str, *, confidence: str = "conf", correct: str = "correct") -> DataFrame:
    """Mean of the running risk in order of falling confidence."""
    rows = items.select(*by, order, (-F.col(confidence)).alias("_c"), (1 - F.col(correct)).alias("_risk"))
    found = running(rows, by, ["_c", order], {"wrong": F.col("_risk"), "seen": F.lit(1).cast("long")})
    return found.groupBy(*by).agg(F.avg((F.col("wrong") + F.col("_risk")) / (F.col("seen") + 1)).alias("aurc"))


def average_ranks(items: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of ``value`` in its group, from 1; equal values share their mean rank."""
    return _with_ranks(items, counted(items, by, value), by, value, name)


def _with_ranks(items: DataFrame, places: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    ranks = places.select(*by, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    match = F.col(f"x.{value}") == F.col(f"y.{value}")
    for c in by:
        match = match & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return items.alias("x").join(ranks.alias("y"), match).select("x.*", f"y.{name}")


def correlations(items: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman (average ranks) and Pearson.  The values are computed once and kept, as both ranks, their ranges and the joins read them."""
    rows = items.select(*by, x, y).checkpoint()
    ranked = _with_ranks(rows, counted(rows, by, x), by, x, "_rx")
    ranked = _with_ranks(ranked, counted(rows.where(F.col(x).isNotNull()), by, y), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("srcc"), F.corr(x, y).alias("plcc"))


def macro_f1(items: DataFrame, by: list[str], *, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    def f1(value: bool) -> Column:
        hit = F.sum(((F.col(predicted) == value) & (F.col(gold) == value)).cast("long"))
        every = F.sum((F.col(predicted) == value).cast("long")) + F.sum((F.col(gold) == value).cast("long"))
        return F.when(hit == 0, 0.0).otherwise(2 * hit / F.nullif(every, F.lit(0)))

    return items.groupBy(*by).agg(((f1(True) + f1(False)) / 2).alias("macro_f1"))


#: Points at which the smoothed gap is taken, the least bandwidth, and halvings of the bandwidth's range.
GRID, FINEST, HALVINGS = 501, 1e-4, 24
#: Moments of 2^DEPTH cells of confidences; kernels end at so many bandwidths.
DEPTH, MOMENTS, FAR = 14, 12, 8.0


def _coarser(m: np.ndarray) -> np.ndarray:
    """Moments (cells, MOMENTS) of cells of twice the width: places in a cell go from -1 to 1, so a child's u becomes (u - 1) / 2 or (u + 1) / 2."""
    p = np.arange(MOMENTS)
    choose = np.array([[math.comb(a, b) for b in p] for a in p], float) / 2.0 ** p[:, None]
    odd = np.where((p[:, None] - p[None, :]) % 2 == 0, 1.0, -1.0)
    return m[0::2] @ (choose * odd).T + m[1::2] @ choose.T


def _smoothed_gap(m: np.ndarray, n: float, width: float) -> float:
    """Integral of the absolute kernel-smoothed residual, kernels reflected once at 0 and at 1, from cells' moments.

    A kernel around c + d is the series of Hermite polynomials in d / width around c; cells are at most 0.61 bandwidths wide, so what MOMENTS terms leave out is below 1e-10 of a
    kernel's height, and what lies beyond FAR bandwidths below 1e-13.  The work is the same for any number of rows.
    """
    half = 0.5 / len(m)
    centre = (np.arange(len(m)) + 0.5) / len(m)
    total = np.zeros(GRID)
    filled = np.flatnonzero(np.abs(m).sum(axis=1))
    m, centre = m[filled] * (half / width) ** np.arange(MOMENTS), centre[filled]
    signs = (-1.0) ** np.arange(MOMENTS)
    for at, own in ((centre, m), (-centre, m * signs), (2 - centre, m * signs)):
        low = np.maximum(np.ceil((at - FAR * width) * (GRID - 1)), 0).astype(int)
        high = np.minimum(np.floor((at + FAR * width) * (GRID - 1)), GRID - 1).astype(int)
        count = np.maximum(high - low + 1, 0)
        cell = np.repeat(np.arange(len(at)), count)
        point = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count) + low[cell]
        z = (point / (GRID - 1) - at[cell]) / width
        before, term, value = np.zeros(len(z)), np.exp(-0.5 * z * z), 0.0
        # term: the Hermite polynomial of order p over p!, times the kernel.
        for p in range(MOMENTS):
            value = value + own[cell, p] * term
            before, term = term, (z * term - before) / (p + 1)
        total += np.bincount(point, value, GRID)
    return float(np.trapezoid(np.abs(total), dx=1 / (GRID - 1))) / (n * width * math.sqrt(2 * math.pi))


def _fixed_point(m: np.ndarray, n: float) -> float:
    """The bandwidth at which the smoothed gap equals itself; the gap at the least bandwidth, if it isn't above that."""
    levels = [m]
    while len(levels[-1]) > 4:
        levels.append(_coarser(levels[-1]))

    def gap(width: float) -> float:
        fits = [x for x in levels if 2.0 / len(x) <= width]
        return _smoothed_gap(fits[-1] if fits else levels[0], n, width)

    ends, first = [FINEST, 1.0], gap(FINEST)
    if first <= FINEST:
        return first
    for _ in range(HALVINGS):
        middle = sum(ends) / 2
        ends[0 if gap(middle) > middle else 1] = middle
    return gap(sum(ends) / 2)


def smooth_calibration_error(items: DataFrame, by: list[str], *, confidence: str = "conf", correct: str = "correct") -> DataFrame:
    """by, n, smece: the bandwidth at which the kernel-smoothed calibration gap equals itself, by halving.

    One aggregation sums the residuals' moments in each of 2^DEPTH cells of confidences (from 0 to 1; nulls are left out), whatever the number of rows; a group is
    then at most so many rows, and its bandwidth is found from these.
    """
    cells = 2**DEPTH
    c, r = F.col(confidence).cast("double"), (F.col(correct) - F.col(confidence)).cast("double")
    cell = F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    rows = items.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).select(*by, cell.alias("_cell"), c.alias("_c"), r.alias("_r"))
    # In a cell, places go from -1 to 1.
    rows = rows.withColumn("_u", (F.col("_c") * cells - F.col("_cell") - 0.5) * 2)
    sums, power = [], F.col("_r")
    for p in range(MOMENTS):
        sums.append(F.sum(power).alias(f"_m{p}"))
        power = power * F.col("_u")
    moments = rows.groupBy(*by, "_cell").agg(F.count("*").alias("_n"), *sums)
    kept = moments.columns[: len(by)]

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((cells, MOMENTS))
        m[g["_cell"].to_numpy()] = g[[f"_m{p}" for p in range(MOMENTS)]].to_numpy(float)
        n = int(g["_n"].sum())
        return pd.DataFrame([[*g[kept].iloc[0], n, _fixed_point(m, n)]], columns=[*kept, "n", "smece"])

    types = dict(items.dtypes)
    keys = by or [F.lit(0).alias("_all")]
    return moments.groupBy(*keys).applyInPandas(solve, ", ".join([*(f"{c} {types[c]}" for c in by), "n long", "smece double"]))


_METRICS: dict[str, object] = {}


def register_metric(name: str, function) -> None:
    """``function(group as pandas) -> float`` becomes a metric that ``measure`` knows by name."""
    _METRICS[name] = function


def measure(items: DataFrame, by: list[str], name: str) -> DataFrame:
    function, types = _METRICS[name], dict(items.dtypes)
    return items.groupBy(*by).applyInPandas(lambda g: pd.DataFrame([[*g[by].iloc[0], float(function(g))]], columns=[*by, name]), ", ".join(f"{c} {types[c]}" for c in by) + f", {name} double")


