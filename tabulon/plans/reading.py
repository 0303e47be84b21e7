"""Queries that write tables as files of other kinds and read these: blobs, split archives and ranges of bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import ranking as rk
from ..sources import archives
from ..sources import fixtures as fx
from ..sources import ranges as rg
from ..sources.commits import Commits
from .registry import plan
from .session import prepared


def _folder(spark: SparkSession, name: str) -> str:
    return f"{prepared(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _archive(spark: SparkSession, sf_dir: str) -> str:
    """All texts in order of doc_id, a line break after each, split over some files: the archive is what these make up one after the other."""
    folder = _folder(spark, "archive")
    _texts(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").write.text(folder)
    return folder


@plan("""SELECT doc_id, octet_length(encode(t)) AS n_bytes, sha256(t) AS digest FROM (SELECT doc_id, coalesce(text, '') || chr(10) || coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), '') AS t FROM documents)""")
def ranged_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and the one after it, as a range of bytes of a split archive: some span two of its files or more."""
    prepared(spark)
    archive = rg.parts(rg.file_sizes(spark, _archive(spark, sf_dir)))
    size = F.octet_length("text").cast("long")
    placed = rk.running(_texts(spark, sf_dir).select("doc_id", size.alias("size")), [], ["doc_id"], {"offset": F.col("size") + 1, "n": F.lit(1).cast("long")}).checkpoint()
    after = placed.select((F.col("n") - 1).alias("n"), F.col("size").alias("next"))
    wanted = placed.join(after, "n", "left").select(F.col("doc_id").alias("id"), F.lit("").alias("blob"), "offset", (F.col("size") + 1 + F.coalesce("next", F.lit(0))).alias("length"))
    return rg.read_ranges(wanted, archive).select(F.col("id").alias("doc_id"), F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@plan("""SELECT CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS n_bytes, CAST(sum(1 + len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), ''))) AS BIGINT) AS n_lines FROM documents""")
def blob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and lines of an archive that is read chunk by chunk."""
    prepared(spark)
    chunks = rg.blob_chunks(spark, _archive(spark, sf_dir), chunk=1 << 16, split=1 << 22)
    # Bytes as Latin-1 letters, one each: a chunk may end within a letter of several bytes.
    text = F.decode("data", "ISO-8859-1")
    return chunks.agg(F.sum(F.octet_length("data")).alias("n_bytes"), F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("n_lines"))


@plan("""SELECT o_orderkey, price FROM (SELECT o_orderkey, CAST(floor(100 * o_totalprice) AS BIGINT) AS at FROM orders WHERE o_totalprice IS NOT NULL) o
ASOF JOIN (SELECT DISTINCT CAST(floor(3000 * p_retailprice) AS BIGINT) AS price FROM part WHERE p_retailprice IS NOT NULL) p ON o.at >= p.price""")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price step (of parts, thirty pieces each) that an order's total reaches."""
    prepared(spark)
    points = fx.read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").where("o_totalprice IS NOT NULL").select("o_orderkey", F.floor(100 * F.col("o_totalprice")).alias("at"))
    steps = fx.read(spark, sf_dir, "part", "p_retailprice").select(F.floor(3000 * F.col("p_retailprice")).alias("price"))
    return iv.last_not_beyond(points, steps, [], start="price").select("o_orderkey", "price")


@plan("SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256(coalesce(text, '')) AS digest FROM documents")
def archived_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of zip files, each a JSON document, read back member by member."""
    folder = _folder(spark, "zips")
    rows = _texts(spark, sf_dir).repartition("doc_id").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".json")).alias("member"), F.to_json(F.struct("doc_id", "text")).alias("text"))
    # An action: archives are there before they are listed.
    archives.write_zips(rows, folder, "member", "text").agg(F.sum("members")).collect()
    found = archives.archived_json(spark, f"{folder}/*.zip").select(F.from_json("value", "doc_id long, text string").alias("d"))
    return found.select("d.doc_id", F.length("d.text").cast("long").alias("n"), F.sha2("d.text", 256).alias("digest"))


@plan("SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS logged, CAST(2 AS INTEGER) AS version FROM documents GROUP BY lang")
def committed_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that was begun with a third of the documents and resumed with all: its log knows the number of its rows."""
    docs = fx.read(spark, sf_dir, "documents", "doc_id", "lang")
    log = Commits(spark, _folder(spark, "table"), key=["doc_id"])
    log.append(docs.where("doc_id % 3 = 0"))
    log.append_missing(docs)
    return log.read().groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", F.lit(log.rows()).cast("long").alias("logged"), F.lit(log.version()).alias("version"))
