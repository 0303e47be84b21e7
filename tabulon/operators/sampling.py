"""Samples that depend on a seed and the rows' keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_uniform


def shuffle_key(seed: int, key: str) -> Column:
    """What a shuffled order sorts by (then by the key)."""
    return keyed_uniform(seed, "shuffle", F.col(key))


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(shuffle_key(seed, key), key)


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(keyed_uniform(seed, "sample", F.col(key)), key).limit(n)


def sample_per_group(df: DataFrame, n: int | Column, seed: int, key: str, group: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(keyed_uniform(seed, "group", F.col(key)), key))
    return df.withColumn("place", place).where(F.col("place") <= n)


def weighted_order(weight: Column, seed: int, operator: str, *keys: Column) -> Column:
    """Exponential keys: the k smallest are a weighted sample without replacement."""
    return -F.ln(F.greatest(keyed_uniform(seed, operator, *keys), F.lit(1e-12))) / weight


def capped_balance(df: DataFrame, cap: Column, order: Column, group: list[str]) -> DataFrame:
    """No more rows of a (class, polarity) than its cap, in order."""
    return df.withColumn("used", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("used") <= cap)


def pick(options: Column, seed: int, operator: str, *keys: Column) -> Column:
    u = keyed_uniform(seed, operator, *keys)
    return F.get(options, F.least(F.floor(u * F.size(options)), F.size(options) - 1).cast("int"))
