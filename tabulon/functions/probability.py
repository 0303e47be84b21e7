"""Probabilities, scoring rules and per-row metrics over ragged arrays of logits and targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / total(e))


def platt(logits: Column, a: Column, b: Column) -> Column:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(a * (F.get(logits, F.lit(0)) - F.get(logits, F.lit(1))) + b)))
    return F.array(p, F.lit(1.0) - p)


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return F.ln(total(F.transform(values, lambda x: F.exp(x - top)))) + top


def valid_mass(valid: Column, others: Column) -> Column:
    """The share of probability that valid tokens have among all, from both sides' logits."""
    v, o = log_sum_exp(valid), log_sum_exp(others)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(o - v))


def first_max(values: Column) -> Column:
    """Index of the largest entry, the first of several."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def majority(target: Column) -> Column:
    """Index of the largest entry, null if several share it."""
    return F.when(F.size(F.filter(target, lambda x: x == F.array_max(target))) == 1, first_max(target))


def one_hot(index: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def confidence(p: Column) -> Column:
    return F.array_max(p)


def correctness(p: Column, y: Column) -> Column:
    """The target's mass on the predicted option (a fraction for soft targets)."""
    return F.get(y, first_max(p))


def nll(p: Column, y: Column) -> Column:
    return -total(F.zip_with(p, y, lambda a, b: b * F.ln(F.least(F.greatest(a, F.lit(1e-12)), F.lit(1.0)))))


def brier(p: Column, y: Column) -> Column:
    return total(F.zip_with(p, y, lambda a, b: (a - b) * (a - b)))


def ranked_probability_score(p: Column, y: Column) -> Column:
    """Squared differences of the cumulative distributions, the last level (always equal) included."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    d = F.zip_with(p, y, lambda a, b: a - b)
    return F.aggregate(d, start, lambda a, x: F.struct((a["c"] + x).alias("c"), (a["s"] + (a["c"] + x) * (a["c"] + x)).alias("s")), lambda a: a["s"])


def proper_loss(p: Column, y: Column, kind: Column, weight: float = 0.3) -> Column:
    """Ranked probability score for ordinal questions, Brier otherwise, plus a share of the cross entropy."""
    ce = -total(F.zip_with(p, y, lambda a, b: b * F.greatest(F.ln(F.greatest(a, F.lit(1e-300))), F.lit(-1e4))))
    return F.when(kind == "score", ranked_probability_score(p, y)).otherwise(brier(p, y)) + F.lit(weight) * ce


def padded(values: Column, k: int, fill: float) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.lit(k) - F.size(values)))


def rotation_average(rotations: Column) -> Column:
    """Scores of K cyclic orders (the r-th shows option (i + r) mod K at place i), averaged per option."""
    k = F.size(rotations)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: total(F.transform(rotations, lambda s, r: F.get(s, F.pmod(i - r, k)))) / k)


def antonym_score(pair: Column, k: Column) -> Column:
    """Logits of k levels between two opposite prompts: level times the difference."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: i * (F.get(pair, F.lit(0)) - F.get(pair, F.lit(1))))


def histogram_target(counts: Column) -> Column:
    return F.transform(counts, lambda x: x / F.aggregate(counts, F.lit(0.0), lambda a, c: a + c))


def _soft_levels() -> list[list[float]]:
    """0.7 on the level and 0.15 on its neighbours, normalised; the best level is an exception."""
    rows = []
    for level in range(4):
        weight = [0.7 if i == level else 0.15 if abs(i - level) == 1 else 0.0 for i in range(5)]
        rows.append([w / sum(weight) for w in weight])
    return [*rows, [0.0, 0.0, 0.0, 0.3, 0.7]]


def soft_level(level: Column) -> Column:
    table = F.array(*[F.array(*map(F.lit, row)) for row in _soft_levels()])
    return F.get(table, level)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; NaN without observations."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + F.lit(z * z) / (4 * n * n))
    nan = F.lit(float("nan"))
    return tuple(F.when(n > 0, (centre + s * half) / (1 + F.lit(z * z) / n)).otherwise(nan) for s in (F.lit(-1.0), F.lit(1.0)))
