"""Binds the record model to the tables at hand.

Documents stand for images, their labels for gold targets, benchmark passages for evaluation images, turns of a
conversation for questions that share an image, events for requests, embeddings for cached features.
Scores are a deterministic stand-in for a model's: a logit gap from the text's length and a keyed draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def surrogate_gap(doc_id: Column, n_chars: Column, slot: str = "noise") -> Column:
    return F.round(F.ln(F.greatest(n_chars, F.lit(1)) / F.lit(1000.0)) + 2 * hashing.keyed_uniform(0, slot, doc_id) - 1, 6)


def items(spark: SparkSession, sf_dir: str, slot: str = "noise") -> DataFrame:
    """One yes/no question per labelled document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    rows = docs.join(read(spark, sf_dir, "labels"), "doc_id")
    gap, q = surrogate_gap(F.col("doc_id"), F.col("n_chars"), slot), F.col("quality").cast("double")
    image = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", F.concat(F.lit("q:"), F.col("doc_id").cast("string")).alias("uid"), image.alias("image_id"), "lang", "source", "n_chars", "quality", "toxic", F.lit("noul").alias("kind"), hashing.calibration_split(image).alias("split"), gap.alias("gap"), F.array(gap / 2, -gap / 2).alias("logits"), F.array(q, 1 - q).alias("target"))


def ordinal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One five-level question per document: the target is one level, logits fall with the distance from a noisy one."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    u, v = hashing.keyed_uniform(0, "level", F.col("doc_id")), hashing.keyed_uniform(0, "guess", F.col("doc_id"))
    level = F.least(F.lit(4), F.bround(4 * u).cast("int"))
    guess = F.round(4 * (0.7 * u + 0.3 * v), 6)
    levels = F.sequence(F.lit(0), F.lit(4))
    return docs.select("doc_id", "lang", level.alias("level"), F.round(4 * u, 6).alias("mos"), F.transform(levels, lambda i: F.when(i == level, 1.0).otherwise(0.0)).alias("target"), F.transform(levels, lambda i: -F.abs(i - guess)).alias("logits"))
