"""Range joins: which intervals a range overlaps.

Both sides are cut into cells of one width, meet by an equality of (group, cell), and each pair is kept in the first cell that it shares only.  With the
width of a typical interval an interval lies in few cells, so the join costs what its result does, and one long group is spread over all its cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running


def overlaps(ranges: DataFrame, intervals: DataFrame, by: list[str], *, width: int | None = None) -> DataFrame:
    """Pairs of ``ranges`` (start, stop) and ``intervals`` (low, high), both of whole numbers without their ends, that share a number and are equal in ``by``.

    Columns of both sides come back (those of ``by`` once).  Empty ones and those with a null overlap nothing.  ``width``: of a cell; by default the mean length of
    an interval.
    """
    if width is None:
        width = max(1, int(intervals.where("high > low").agg(F.avg(F.col("high") - F.col("low"))).first()[0] or 1))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    x = ranges.where("stop > start").withColumn("_cell", cells("start", "stop"))
    y = intervals.where("high > low").withColumn("_cell", cells("low", "high"))
    first = F.floor(F.greatest("start", "low") / width)
    return x.join(y, [*by, "_cell"]).where((F.col("start") < F.col("high")) & (F.col("low") < F.col("stop")) & (F.col("_cell") == first)).drop("_cell")


def last_not_beyond(points: DataFrame, starts: DataFrame, by: list[str], *, at: str = "at", start: str = "start") -> DataFrame:
    """For each point the largest start (of the same ``by``) that isn't beyond it; points before all starts, and null ones, are left out.  Whole numbers only.

    A start is made an interval that ends where the next one begins, or behind the last point; starts are put in order by ranges, not in one task."""
    rows = starts.where(F.col(start).isNotNull()).select(*by, F.col(start).cast("long").alias(start)).distinct()
    placed = running(rows, by, [start], {"_n": F.lit(1).cast("long")}).checkpoint()
    after = placed.select(*by, (F.col("_n") - 1).alias("_n"), F.col(start).alias("_next"))
    last = points.groupBy(*by).agg((F.max(at) + 1).alias("_last"))
    found = placed.join(after, [*by, "_n"], "left")
    found = found.join(last, by) if by else found.crossJoin(F.broadcast(last))
    intervals = found.select(*by, F.col(start).alias("low"), F.coalesce("_next", F.greatest("_last", F.col(start) + 1)).alias("high"))
    ranges = points.withColumns({"start": F.col(at), "stop": F.col(at) + 1})
    return overlaps(ranges, intervals, by).drop("start", "stop", "high").withColumnRenamed("low", start)
