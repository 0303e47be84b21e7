"""A corpus pipeline made of the operators in ``tabulon.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import decontaminate, exact, jaccard, langid, packing
from tabulon.llm.cluster import prepare, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language: null, empty and letterless texts go, and all if no row is labelled.  Each row goes by its own text,
    whatever its id; an empty table stays empty, and columns of any name stay as they are."""
    prepare(spark)
    return langid.drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal after folding A-Z: that of the largest id, one that has an id first, and of repeated
    rows exactly one.  Null counts as empty; an empty table stays empty."""
    prepare(spark)
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, rows without one last.  Texts without words are near nothing and stay;
    where ids repeat or lack, rows are told apart by their texts; an empty table stays empty."""
    prepare(spark)
    return jaccard.drop_near(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs; each goes by its own text, whatever its id.  Null and empty texts stay, and all
    rows where the benchmark has no words."""
    prepare(spark)
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences; a null text is packed as an empty one, which is the end's id alone, and
    repeated rows each on their own.  An empty table gives no pieces."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language ID", identified), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]

#: Language ID and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
