"""Choosing rows: by names and prefixes, the first or last of a key, by priority, and in step with another run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_segment(path: Column, place: int = 1) -> Column:
    """A part of a path, counted from 1; null where there are fewer."""
    return F.nullif(F.split_part(path, F.lit("/"), F.lit(place)), F.lit(""))


def known_generators(rows: DataFrame, segment: str, allowed: dict[str, str], denied: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose path segment is a known generator that isn't denied, with its name.  The list is code, so the lookup is an
    expression and not a join."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in allowed.items() for x in kv]), F.col(segment))
    return rows.where(F.col(segment).isin(*allowed) & ~F.col(segment).isin(*denied)).withColumn("generator", name)


def is_upright(rotation: Column) -> Column:
    """Not turned, as written: empty (also where a reader made it null) or "0.0"."""
    return F.coalesce(rotation, F.lit("")).isin("", "0.0")


def without_prefix(name: Column, prefix: str) -> Column:
    """Names that don't begin with the prefix, which is no pattern."""
    return ~F.startswith(name, F.lit(prefix))


def namespace(image_id: Column) -> Column:
    """What stands before the first colon; null without one."""
    return F.when(F.contains(image_id, F.lit(":")), F.split_part(image_id, F.lit(":"), F.lit(1)))


def first_and_last(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The value that a key has first, and the one that overwrites all before it."""
    return rows.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def latest(rows: DataFrame, by: list[str], order: str, *, usable: Column | None = None) -> DataFrame:
    """The last usable row of each configuration, as a whole; partial maxima go through the shuffle, not the rows."""
    rows = rows if usable is None else rows.where(usable)
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def head_of_each(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first rows of each source; the window's limit is applied before the shuffle, so a hot source sends few rows."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def largest_first(groups: DataFrame, n: str, name: str) -> DataFrame:
    """Groups, the largest first; equal ones by name.  Groups are few, their order is a column."""
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc(n), name)).cast("long"))


def by_priority(rows: DataFrame, key: str, preferred: Column, order: str) -> DataFrame:
    """The copy of each key that stays: a preferred one if there is any, then the smallest."""
    return rows.groupBy(key).agg(F.min_by(order, F.struct(~preferred, F.col(order))).alias("kept"))


def ordered_distinct(rows: DataFrame, value: str, order: Column) -> DataFrame:
    """Distinct values with the place of their first appearance."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))


def realigned(rows: DataFrame, candidates: str, other: str, values: str) -> DataFrame:
    """``values`` belong to the candidates of ``other``; adds ``aligned``, the same in the order of ``candidates`` (null for one that
    the other run lacks)."""
    pairs = F.map_from_entries(F.arrays_zip(F.col(other).alias("k"), F.col(values).alias("v")))
    return rows.withColumn("aligned", F.transform(candidates, lambda c: F.try_element_at(pairs, c)))


def reworded(decisions: DataFrame, question: str, *, flip: bool) -> DataFrame:
    """The same items in another wording; with ``flip`` the new wording's yes means the old one's no."""
    out = decisions.withColumn("uid", F.concat("uid", F.lit("-reworded"))).withColumn("question", F.lit(question))
    return out.withColumn("target", F.reverse("target")) if flip else out


def looked_up(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """An inner join in which a key without a name is an error."""
    joined = rows.join(names.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {key}: "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key]))
    return joined.withColumn(key, checked).drop("_found")


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key (any struct) none of the known ones has; the keys meet by hash, and are compared whole."""
    return rows.join(known.select(key).distinct(), key, "left_anti")
