"""Orders over whole groups without a task per group.

A window over a group's rows puts the group into one task.  Here rows are cut into ranges of (group, order); each range is summed on its
own, and the sums of the ranges before it are added.  A group may so be as large as the table: its ranges lie in many tasks, and only a
row per group and range is collected in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of ``sums``, its total over the rows of the same group that come before in order (which must be total)."""
    own = rows.withColumns({f"_{k}": c for k, c in sums.items()})
    # Ranges are fixed by the checkpoint: both passes see the same.
    own = own.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    each = own.groupBy(*by, "_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(*by, "_part", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = own.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_{k}").over(here), F.lit(0)) for k in sums})
    match = F.lit(True)
    for c in [*by, "_part"]:
        match = match & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    joined = local.alias("x").join(offsets.alias("y"), match)
    return joined.select(*[F.col(f"x.{c}") for c in rows.columns], *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, before: each distinct value, how often it occurs, and how many rows have a smaller one."""
    distinct = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(distinct, by, [value], {"before": F.col("n")})


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n, and a column for each share: the exact quantile, linear between the two nearest values."""
    places = counted(rows, by, value)
    total = places.groupBy(*by).agg(F.sum("n").alias("_all"))
    joined = _beside(places, total, by)
    columns = [F.max("_all").alias("n")]
    for name, share in shares.items():
        at = (F.col("_all") - 1) * F.lit(share)
        for side, k in (("l", F.floor(at)), ("h", F.ceil(at))):
            columns.append(F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value))).alias(f"_{side}_{name}"))
        columns.append(F.max(at - F.floor(at)).alias(f"_f_{name}"))
    found = joined.groupBy(*by).agg(*columns)
    return found.select(*by, "n", *[(F.col(f"_l_{k}") + (F.col(f"_h_{k}") - F.col(f"_l_{k}")) * F.col(f"_f_{k}")).alias(k) for k in shares])


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what is known of their group; null keys meet too."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))
    match = F.lit(True)
    for c in by:
        match = match & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return rows.alias("x").join(groups.alias("y"), match).select("x.*", *[F.col(f"y.{c}") for c in groups.columns if c not in by])


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Consecutive numbers from 0 in order."""
    return running(rows, [], order, {name: F.lit(1).cast("long")})
