"""Fits of temperatures and Platt scaling, and scoring with them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as pr


COLDEST, HOTTEST = 0.05, 20.0


class _Fit:
    """What is known of one group: the inverse temperature between its bounds, and slope and constant with the loss there."""

    def __init__(self) -> None:
        self.beta, self.low, self.high = 1.0, 1 / HOTTEST, 1 / COLDEST
        self.best, self.at, self.step = (np.inf, 1.0, 0.0), (1.0, 0.0), np.zeros(2)
        self.n, self.yes_no, self.done, self.mean = 0, False, False, 0.5

    def learn(self, r) -> None:
        self.n, self.yes_no, self.mean = r["_n"], r["_yes_no"], r["_mean"]
        # The loss is convex in the inverse temperature: its slope tells the side, Newton's step the place.
        self.low, self.high = (self.beta, self.high) if r["_d1"] < 0 else (self.low, self.beta)
        beta = self.beta - r["_d1"] / max(r["_d2"], 1e-300)
        beta = beta if self.low < beta < self.high else (self.low + self.high) / 2
        still = abs(beta - self.beta) < 1e-10
        self.beta = float(beta)
        if self.yes_no:
            if r["_loss"] > self.best[0]:
                self.step = self.step / 2
            else:
                self.best = (r["_loss"], *self.at)
                h = np.array([[r["_h11"], r["_h12"]], [r["_h12"], r["_h22"]]]) + 1e-12 * np.eye(2)
                self.step = -np.linalg.solve(h, [r["_g1"], r["_g2"]])
            still = still and np.abs(self.step).max() < 1e-10
            self.at = (float(self.best[1] + self.step[0]), float(self.best[2] + self.step[1]))
        self.done = still

    def platt(self) -> tuple[float | None, float | None]:
        if not self.yes_no:
            return None, None
        if self.best[1] >= 0:
            return float(self.best[1]), float(self.best[2])
        mean = float(np.clip(self.mean, 1e-12, 1 - 1e-12))
        return 0.0, float(np.log(mean / (1 - mean)))


def fit(items: DataFrame, by: list[str], *, rounds: int = 60) -> DataFrame:
    """One row per group of calibration items (kind, logits, target): n, temperature (between 0.05 and 20), and for yes/no questions the
    Platt slope a >= 0 and constant b, each of least mean log loss.

    Newton steps for all groups at once, from sums alone: a round is one aggregation, and a group (of which there are few) sends one row
    to the driver, however many items it has.
    """
    x = items.select(*by, "kind", "logits", "target").persist()
    try:
        known: dict[tuple, _Fit] = {tuple(r): _Fit() for r in x.select(*by).distinct().collect()}
        types = dict(items.dtypes)
        keys = ", ".join(f"{c} {types[c]}" for c in by)
        dot = lambda a, b: pr.total(F.zip_with(a, b, lambda u, v: u * v))
        for _ in range(rounds if known else 0):
            state = items.sparkSession.createDataFrame([(*k, f.beta, *f.at) for k, f in known.items()], f"{keys}, _beta double, _a double, _b double")
            match = F.lit(True)
            for c in by:
                match = match & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
            rows = x.alias("x").join(F.broadcast(state).alias("y"), match).select("x.*", "_beta", "_a", "_b")
            p = pr.softmax(F.col("logits"), 1.0 / F.col("_beta"))
            rows = rows.withColumn("_p", p).withColumn("_pz", dot("_p", "logits")).withColumn("_gap", F.get("logits", F.lit(0)) - F.get("logits", F.lit(1))).withColumn("_u", F.col("_a") * F.col("_gap") + F.col("_b"))
            rows = rows.withColumn("_q", 1 / (1 + F.exp(-F.col("_u")))).withColumn("_y", F.get("target", F.lit(0)))
            gap, q, y, u, mass = (F.col(c) for c in ("_gap", "_q", "_y", "_u", "_mass"))
            w = q * (1 - q)
            square = pr.total(F.zip_with("_p", "logits", lambda a, z: a * z * z))
            soft = F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))
            found = rows.withColumn("_mass", pr.total(F.col("target"))).groupBy(*by).agg(
                F.count("*").alias("_n"), F.bool_and(F.col("kind") == "noul").alias("_yes_no"), F.avg(y).alias("_mean"),
                F.avg(mass * F.col("_pz") - dot("target", "logits")).alias("_d1"), F.avg(mass * (square - F.col("_pz") * F.col("_pz"))).alias("_d2"),
                F.avg(soft - y * u).alias("_loss"), F.avg((q - y) * gap).alias("_g1"), F.avg(q - y).alias("_g2"), F.avg(w * gap * gap).alias("_h11"), F.avg(w * gap).alias("_h12"), F.avg(w).alias("_h22"),
            )
            for r in found.collect():
                known[tuple(r[c] for c in by)].learn(r)
            if all(f.done for f in known.values()):
                break
        return items.sparkSession.createDataFrame([(*k, f.n, 1 / f.beta, *f.platt()) for k, f in known.items()], f"{keys}, n long, temperature double, a double, b double")
    finally:
        x.unpersist()


def calibrated(kind: Column, logits: Column, temperature: Column, a: Column, b: Column) -> Column:
    """Platt scaling for yes/no questions that have it, else a temperature (1 where none is known)."""
    return F.when((kind == "noul") & a.isNotNull() & b.isNotNull(), pr.platt(logits, a, b)).otherwise(pr.softmax(logits, F.coalesce(temperature, F.lit(1.0))))
