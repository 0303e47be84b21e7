"""Readers: Parquet, JSON lines, JSON members of archives, CSV and TSV, directories of runs (byte ranges: see ``ranges``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives

_SOURCES: dict[str, object] = {}


def register_source(name: str):
    """Makes a loader (spark, path) -> DataFrame known by a name."""

    def keep(loader):
        _SOURCES[name] = loader
        return loader

    return keep


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return _SOURCES[name](spark, path, **options)


@register_source("parquet")
def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


@register_source("jsonl")
def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


@register_source("csv")
def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """With a header, quoted line breaks, and fields of any size."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=True, escape='"', maxCharsPerColumn=-1)


@register_source("archive")
def archived_json(spark: SparkSession, path: str, **options) -> DataFrame:
    return archives.archived_json(spark, path, **options)


def run_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation records with the candidate and benchmark that the file name gives (candidate__benchmark.jsonl)."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    df = spark.read.schema(schema).json(path)
    return df.select("*", F.split_part(name, F.lit("__"), F.lit(1)).alias("candidate"), F.split_part(name, F.lit("__"), F.lit(2)).alias("benchmark"))


# Fixed value: how a run directory is named.
RUN_NAME = r"(C\d\w*)_(ep[\d.]+|[\de\-+]+)_(lr[A-Z])_s(\d+)(?:_(\w+))?$"


def run_name(name: Column) -> Column:
    keys = ("cand", "budget", "lr", "seed", "sanity")
    return F.struct(*[F.nullif(F.regexp_extract(name, RUN_NAME, i + 1), F.lit("")).alias(k) for i, k in enumerate(keys)])


def class_names(spark: SparkSession, names: list[str]) -> DataFrame:
    """The dimension that class-label metadata of a file stands for."""
    return spark.createDataFrame(list(enumerate(names)), "label int, name string")


def tensor_sizes(headers: DataFrame, header: str) -> DataFrame:
    """parts and bytes: how many tensors a header (JSON text, an entry with its range of bytes for each) lists, and their size."""
    entries = F.from_json(header, "map<string, struct<data_offsets: array<bigint>>>")
    ranges = F.filter(F.map_values(F.map_filter(entries, lambda k, v: k != "__metadata__")), lambda v: v["data_offsets"].isNotNull())
    return headers.withColumn("_r", ranges).withColumn("parts", F.size("_r").cast("long")).withColumn("bytes", F.aggregate("_r", F.lit(0).cast("long"), lambda a, v: a + F.get(v["data_offsets"], F.lit(1)) - F.get(v["data_offsets"], F.lit(0)))).drop("_r")


def model_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, header of model files that begin with the header's length (8 bytes, the lowest first) and its JSON text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    size = F.conv(F.hex(F.reverse(F.substring("content", 1, 8))), 16, 10).cast("int")
    return files.select("path", F.substring("content", F.lit(9), size).cast("string").alias("header"))
