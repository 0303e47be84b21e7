"""Label rules: how raw answers, ratings and votes become targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Licence ids that allow reuse, with their addresses; rating recodes.
ALLOWED_LICENCES = {4: "http://creativecommons.org/licenses/by/2.0/", 7: "http://flickr.com/commons/usage/", 8: "http://www.usa.gov/copyright.shtml"}
RATING_TO_LEVEL = {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 4, 7: 4}


def licence_problem(number: Column, url: Column) -> Column:
    """Why a licence doesn't allow reuse: its number isn't one of these, or goes with another address; else null."""
    own = F.element_at(F.create_map(*[F.lit(x) for kv in ALLOWED_LICENCES.items() for x in kv]), F.when(number.isin(*ALLOWED_LICENCES), number).cast("int"))
    return F.when(~F.coalesce(number.isin(*ALLOWED_LICENCES), F.lit(False)), "licence").when(~own.eqNullSafe(url), "url")


def tri_state_flag(confidence: Column) -> Column:
    """1 and 0 however they are written; anything else is an error."""
    value = F.try_cast(confidence, "double") if hasattr(F, "try_cast") else confidence.try_cast("double")
    return F.when(value == 1, True).when(value == 0, False).otherwise(F.raise_error(F.concat(F.lit("not a label: "), confidence)).cast("boolean"))


def banded_answer(score: Column, no_below: float = 0.5, yes_from: float = 0.917) -> Column:
    """Yes for a low score, no for a high one, null between."""
    return F.when(score <= no_below, "yes").when(score >= yes_from, "no")


def ordinal_bucket(score: Column) -> Column:
    """Five levels, halves to the even one."""
    return F.least(F.lit(4), F.bround(4 * score).cast("int"))


def rating_level(rating: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RATING_TO_LEVEL.items() for x in kv]), F.when(rating.between(1, 7), rating))


def rating_is_bad(rating: Column) -> Column:
    """Yes up to 3, no from 6, null between and below 1."""
    return F.when(rating < 1, F.lit(None)).when(rating <= 3, True).when(rating >= 6, False)


def group_state(counts: Column) -> Column:
    """True if any category was named twice, False if none at all, else null."""
    return F.when(F.array_max(counts) >= 2, True).when(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) == 0, False)


def keep_clear(is_bad: Column, tag: Column) -> Column:
    """Bad items, and of the others those that are tagged good."""
    return is_bad | (tag == "good")


def part_named(parts: Column, tags: Column, part: str) -> Column:
    return (F.coalesce(F.element_at(parts, part), F.lit(0)) > 0) | F.exists(tags, lambda t: F.contains(t, F.lit(part)))


def vote_share(yes: Column, no: Column, least: int = 5) -> Column:
    return F.when(yes + no >= least, F.array(yes / (yes + no), no / (yes + no)))


def agreement_reason(gold_votes: Column, least: int = 3) -> Column:
    return F.when(gold_votes < least, "low_agreement").otherwise("kept")


def without_padding(options: Column, gold: Column) -> Column:
    """Options that aren't "nan", and the gold option's new index (null if it is padding or out of range)."""
    kept = F.filter(options, lambda o: F.lower(o) != "nan")
    at = F.size(F.filter(F.slice(options, F.lit(1), gold + 1), lambda o: F.lower(o) != "nan")) - 1
    ok = (gold >= 0) & (gold < F.size(options)) & (F.lower(F.get(options, gold)) != "nan")
    return F.struct(kept.alias("options"), F.when(ok, at).alias("gold"))


def matched_once(options: Column, gold: Column) -> Column:
    return F.size(F.filter(options, lambda o: F.trim(o) == F.trim(gold))) == 1


def swapped_by_hash(key: Column, options: Column) -> Column:
    """Turns a pair around when the key's SHA-1 is odd."""
    return F.when(F.conv(F.right(F.sha1(key.cast("binary")), F.lit(1)), 16, 10).cast("int") % 2 == 1, F.reverse(options)).otherwise(options)


def top_answers(votes: DataFrame, group: list[str], answer: str, order: str, k: int) -> DataFrame:
    """The k most frequent answers of each group, ties in order of first appearance; adds n and place."""
    counted = votes.groupBy(*group, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).where(F.col("place") <= k)


def face_boxes(boxes: DataFrame, width: float = 0.15, per_image: int = 2, least_side: int = 64, ties: tuple[str, ...] = ()) -> DataFrame:
    """The largest boxes of each image that are neither groups nor drawings; the side limit comes after the choice.  Boxes of one place and
    size come in the order of ``ties``."""
    wide = boxes.where((F.col("x1") - F.col("x0") >= width) & ~F.col("is_group") & ~F.col("is_depiction"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    first = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(area), "x0", "y0", *ties))
    side = F.least((F.col("x1") - F.col("x0")) * F.col("w"), (F.col("y1") - F.col("y0")) * F.col("h"))
    return wide.withColumn("k", first).where(F.col("k") <= per_image).where(side >= least_side)


def context_box(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, scale: float = 2.2) -> Column:
    """A square around a box, clipped to the photo and rounded half to even."""
    half = F.greatest(x1 - x0, y1 - y0) * scale / 2
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return F.struct(F.bround(F.greatest(F.lit(0.0), cx - half)).alias("x0"), F.bround(F.greatest(F.lit(0.0), cy - half)).alias("y0"), F.bround(F.least(w, cx + half)).alias("x1"), F.bround(F.least(h, cy + half)).alias("y1"))


def aspect_agrees(w: Column, h: Column, other_w: Column, other_h: Column, tolerance: float = 0.02) -> Column:
    return F.abs(w / h - other_w / other_h) <= tolerance * (other_w / other_h)
