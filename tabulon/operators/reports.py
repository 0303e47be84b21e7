"""Reports over runs: seeds, wordings, pivots, agreement, latency, game protocols."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import counted, quantiles


def over_seeds(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation (null for one seed), with every seed's value."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("seed", value))), lambda x: x[value])
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), each.alias("each"))


def best_run(runs: DataFrame, by: list[str], value: str, tie: str, *, largest: bool = False) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value) if largest else F.asc(value), tie)
    return runs.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def report_items(items: DataFrame, by: list[str]) -> DataFrame:
    """The report split of each group, or all of its items where it has none."""
    some = F.sum((F.col("split") == "report").cast("int")).over(Window.partitionBy(*by))
    return items.withColumn("_some", some).where((F.col("split") == "report") | (F.col("_some") == 0)).drop("_some")


def pivoted(cells: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    return cells.groupBy(row).pivot(column, values).agg(F.first(value))


def grouped_every_way(items: DataFrame, attributes: list[str], aggregates: list[Column]) -> DataFrame:
    """Each attribute on its own, and everything: attribute, value, and the aggregates."""
    out = items.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes], F.struct(F.lit("all").alias("attribute"), F.lit("all").alias("value")))).alias("_g"))
    return out.groupBy(F.col("_g.attribute").alias("attribute"), F.col("_g.value").alias("value")).agg(*aggregates)


def overlapping_groups(rules: dict[str, Column]) -> Column:
    """All groups that a row belongs to."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def agreement(answers: DataFrame, item: str, rater: str, choice: str) -> DataFrame:
    """How often two raters choose alike; raters are few, items many."""
    a, b = answers.select(item, F.col(rater).alias("a"), F.col(choice).alias("x")), answers.select(item, F.col(rater).alias("b"), F.col(choice).alias("y"))
    return a.join(b, item).where("a < b").groupBy("a", "b").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("share"), F.count("*").alias("n"))


def latency(requests: DataFrame, by: list[str], value: str) -> DataFrame:
    means = requests.groupBy(*by).agg(F.avg(value).alias("mean"))
    return quantiles(requests, by, value, {"p50": 0.5, "p95": 0.95}).join(means, by).select(*by, "p50", "p95", "mean", "n")


def nearest_rank(requests: DataFrame, by: list[str], value: str, q: float = 0.95) -> DataFrame:
    """The value at place int(q n) of the sorted ones (another convention than ``latency``)."""
    places = counted(requests, by, value)
    total = places.groupBy(*by).agg(F.sum("n").alias("_all"))
    k = F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(q)))
    return places.join(total, by).where((F.col("before") <= k) & (k < F.col("before") + F.col("n"))).select(*by, F.col(value).alias("p95"), F.col("_all").alias("n"))


def cost_fit(rows: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    """Least squares y = c + a x1 + b x2 from sums alone, with R2 and the mean absolute percentage error."""
    s = rows.agg(*[F.avg(e).alias(n) for n, e in {"u": F.col(x1), "v": F.col(x2), "w": F.col(y)}.items()])
    centred = rows.crossJoin(F.broadcast(s)).select((F.col(x1) - F.col("u")).alias("p"), (F.col(x2) - F.col("v")).alias("q"), (F.col(y) - F.col("w")).alias("r"), x1, x2, y, "u", "v", "w")
    m = centred.agg(*[F.sum(F.col(i) * F.col(j)).alias(i + j) for i, j in (("p", "p"), ("p", "q"), ("q", "q"), ("p", "r"), ("q", "r"))], F.first("u").alias("u"), F.first("v").alias("v"), F.first("w").alias("w"))
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    fit = m.select(((F.col("pr") * F.col("qq") - F.col("qr") * F.col("pq")) / det).alias("a"), ((F.col("qr") * F.col("pp") - F.col("pr") * F.col("pq")) / det).alias("b"), "u", "v", "w")
    fit = fit.withColumn("c", F.col("w") - F.col("a") * F.col("u") - F.col("b") * F.col("v"))
    off = rows.crossJoin(F.broadcast(fit)).withColumn("e", F.col(y) - F.col("c") - F.col("a") * F.col(x1) - F.col("b") * F.col(x2))
    return off.groupBy("c", "a", "b").agg((1 - F.sum(F.col("e") * F.col("e")) / F.sum((F.col(y) - F.col("w")) * (F.col(y) - F.col("w")))).alias("r2"), F.avg(F.abs(F.try_divide(F.col("e"), F.col(y)))).alias("mape"), F.count("*").alias("n"))


def step_costs(steps: DataFrame, tokens: str, sequences: str, flops: str) -> DataFrame:
    """Least squares flops = a tokens + b sequences without a constant, from five sums; neither cost is below zero."""
    t, q, y = F.col(tokens), F.col(sequences), F.col(flops)
    s = steps.agg(*[F.sum(e).alias(n) for n, e in {"tt": t * t, "tq": t * q, "qq": q * q, "ty": t * y, "qy": q * y}.items()])
    det = F.col("tt") * F.col("qq") - F.col("tq") * F.col("tq")
    return s.select(F.greatest((F.col("ty") * F.col("qq") - F.col("qy") * F.col("tq")) / det, F.lit(0.0)).alias("per_token"), F.greatest((F.col("qy") * F.col("tt") - F.col("ty") * F.col("tq")) / det, F.lit(0.0)).alias("per_sequence"))


def projected_ms(layers: Column, flops: Column, size: Column) -> Column:
    """Latency on other hardware: launch costs, then the larger of memory and arithmetic time."""
    return F.lit(0.15) + F.lit(0.036) * layers + F.greatest(size / F.lit(250e9), flops / F.lit(50e12)) * 1e3


def game_protocol(moves: DataFrame, by: list[str]) -> DataFrame:
    """Per game first, then over games (a mean of games' means)."""
    games = moves.groupBy(*by, "game").agg(F.count("*").alias("moves"), F.avg(F.col("legal").cast("double")).alias("legal"), F.avg(F.col("agrees").cast("double")).alias("agrees"), F.percentile("ms", F.lit(0.5)).alias("ms"))
    return games.groupBy(*by).agg(F.count("*").alias("games"), F.avg("moves").alias("moves_mean"), F.percentile("moves", F.lit(0.5)).alias("moves_median"), F.max("moves").alias("moves_max"), F.avg("legal").alias("legal"), F.avg("agrees").alias("agrees"), F.avg("ms").alias("ms"))


def vector_change(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine and relative change of pairs of vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    x, y = F.col(a), F.col(b)
    d = F.zip_with(x, y, lambda p, q: p.cast("double") - q.cast("double"))
    return pairs.withColumn("cosine", dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).withColumn("change", F.sqrt(dot(d, d)) / F.sqrt(dot(x, x)))


def linear_probe(rows: DataFrame, features: str, label: str, *, test: str, strengths: tuple[float, ...] = (0.01, 0.1, 1.0), rounds: int = 200) -> DataFrame:
    """AUROC on test rows of a logistic regression on standardised vectors, its strength chosen on inner validation rows.

    Rows: features (array), label (0 or 1), test and inner (boolean).  The fit is by gradient steps over sums per row group.
    """

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(g[features].to_numpy()).astype(float), g[label].to_numpy(float)
        t, inner = g[test].to_numpy(bool), g["inner"].to_numpy(bool)

        def fitted(at: np.ndarray, c: float) -> np.ndarray:
            mean, sd = x[at].mean(axis=0), x[at].std(axis=0) + 1e-9
            z, w = np.c_[(x - mean) / sd, np.ones(len(x))], np.zeros(x.shape[1] + 1)
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-(z[at] @ w)))
                h = (z[at] * (p * (1 - p))[:, None]).T @ z[at] + np.eye(len(w)) / c
                step = np.linalg.solve(h, z[at].T @ (p - y[at]) + w / c)
                w -= step
                if np.abs(step).max() < 1e-9:
                    break
            return z @ w

        def area(s: np.ndarray, v: np.ndarray) -> float:
            p, n = s[v > 0], np.sort(s[v <= 0])
            return float((np.searchsorted(n, p, "left") + np.searchsorted(n, p, "right")).mean() / 2 / len(n)) if len(p) and len(n) else float("nan")

        def held(c: float) -> float:
            found = area(fitted(~t & ~inner, c)[~t & inner], y[~t & inner])
            return -1.0 if np.isnan(found) else found

        best = max(strengths, key=held)
        return pd.DataFrame([[best, area(fitted(~t, best)[t], y[t]), int(t.sum())]], columns=["strength", "auroc", "n"])

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(solve, "strength double, auroc double, n long")
