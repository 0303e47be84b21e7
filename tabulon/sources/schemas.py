"""Schemas of the record model, and the checks that a decision has to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISION = "uid string, source string, kind string, question string, candidates array<string>, target array<double>, image_bytes binary, image_id string, meta map<string,string>"
EVALUATION = "uid string, image_id string, split string, kind string, k int, target array<double>, logits array<double>, mos double, mass double"
ATTRIBUTION = "image_id string, source string, license_id int, license string, license_name string, original string, author string, author_url string, title string, path string, dhash string, derived string"
TEACHER = "uid string, p array<double>, c array<string>"
KINDS = ("choice", "noul", "score")


def decision_problem() -> Column:
    """Why a decision is not valid, or null."""
    mass = F.aggregate("target", F.lit(0.0), lambda a, x: a + x)
    trimmed = F.transform("candidates", lambda c: F.trim(c))
    return (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
        .when(F.col("candidates").isNull() | F.col("target").isNull() | (F.size("candidates") != F.size("target")), "length")
        .when(F.size("candidates") < 2, "options")
        .when(F.exists("target", lambda x: x.isNull()) | (F.abs(mass - 1) >= 1e-4), "mass")
        .when(F.exists(trimmed, lambda c: c == "") | (F.size(F.array_distinct(trimmed)) < F.size(trimmed)), "candidates")
    )


def validated(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("problem", decision_problem())
