"""Ranges of bytes out of large files, and of archives that are split over several.

A range is never cut out of a whole file that was read: its pieces (file, offset, length) are found by a range join with the files' places, dealt out in
the order of files and offsets, and read by seeking.  ``BlobChunks`` is a data source that scans files of any size, its partitions being stretches of a file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.intervals import overlaps
from ..operators.ranking import running

#: What a batch of read ranges holds at most, but for a single longer one.
BATCH_BYTES = 16 << 20


def _opened(path: str):
    """A seekable file of a local path or an address that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _read(file, path: str, offset: int, length: int) -> bytes:
    file.seek(offset)
    data = file.read(length)
    if len(data) != length:
        raise EOFError(f"{path}: {length} bytes at {offset} were asked for, and {len(data)} are there")
    return data


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, size of files, whose contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def parts(files: DataFrame, *, blob: str | None = None) -> DataFrame:
    """blob, path, low, high: where each file (path, size) lies in the archive that the files of a blob make up in the order of their paths.  Without ``blob`` all
    files make up one, whose name is null."""
    rows = files.select((F.col(blob) if blob else F.lit("")).alias("blob"), "path", F.col("size").cast("long").alias("size"))
    return running(rows, ["blob"], ["path"], {"low": F.col("size")}).select("blob", "path", "low", (F.col("low") + F.col("size")).alias("high"))


def pieces(ranges: DataFrame, archive: DataFrame) -> DataFrame:
    """id, place (of the piece in its range), path, offset, length: the parts of files that ranges (id, blob, offset, length) are made of.  A length of -1
    goes to the archive's end."""
    ends = archive.groupBy("blob").agg(F.max("high").alias("_end"))
    whole = ranges.join(ends, "blob").withColumn("stop", F.when(F.col("length") < 0, F.col("_end")).otherwise(F.col("offset") + F.col("length")))
    found = overlaps(whole.select("id", "blob", F.col("offset").cast("long").alias("start"), "stop"), archive, ["blob"])
    start, stop = F.greatest("start", "low"), F.least("stop", "high")
    return found.select("id", (start - F.col("start")).alias("place"), "path", (start - F.col("low")).alias("offset"), (stop - start).alias("length"))


def read_pieces(rows: DataFrame) -> DataFrame:
    """Adds the bytes (data) of each (path, offset, length).  A task reads files from front to back, and hands on some 16 MB at a time."""
    names = rows.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        for batch in batches:
            kept, data, size = [], [], 0
            where = zip(*[batch.column(names.index(c)).to_pylist() for c in ("path", "offset", "length")], strict=True)
            for i, (path, offset, length) in enumerate(where):
                if path != open_path:
                    if file is not None:
                        file.close()
                    open_path, file = path, _opened(path)
                if data and size + length > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(data, pa.binary())], names=[*names, "data"])
                    kept, data, size = [], [], 0
                kept.append(i)
                data.append(_read(file, path, offset, length))
                size += length
            if data:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(data, pa.binary())], names=[*names, "data"])
        if file is not None:
            file.close()

    # The number of tasks is given: by the size of their list, not of what it asks for, they would be put together.
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", data binary")


def read_ranges(ranges: DataFrame, archive: DataFrame) -> DataFrame:
    """id, data of ranges (id, blob, offset, length) of archives that ``parts`` describes; what goes beyond an archive's end is left out, and a range without a byte
    is empty.  Offsets may lie beyond 2 GB, and a range may span any number of files; only its own bytes have to fit in a row."""
    found = read_pieces(pieces(ranges, archive)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "data"))).alias("p"))
    data = F.aggregate(F.transform("p", lambda p: p["data"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return ranges.select("id").join(found, "id", "left").select("id", F.coalesce(data, F.lit(b"")).alias("data"))


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk, self.split = options["path"], int(options.get("chunk", 1 << 20)), int(options.get("split", 64 << 20))

    def partitions(self) -> list[Stretch]:
        """Stretches of ``split`` bytes; each is whole chunks, so that chunks are the same however files are split."""
        step = max(1, self.split // self.chunk) * self.chunk
        path = "/" + self.path.removeprefix("file:").lstrip("/") if self.path.startswith("file:") else self.path
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = path[: path.index("://") + 3] if "://" in path else ""
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")))
        return [Stretch(prefix + p, a, min(a + step, size)) for p, size in files for a in range(0, size, step)]

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        with _opened(stretch.path) as file:
            for offset in range(stretch.start, stretch.stop, self.chunk):
                data = _read(file, stretch.path, offset, min(self.chunk, stretch.stop - offset))
                yield pa.RecordBatch.from_arrays([pa.array([stretch.path]), pa.array([offset], pa.int64()), pa.array([data], pa.binary())], names=["path", "offset", "data"])


class BlobChunks(DataSource):
    """path, offset, data of all files under ``path``: rows of ``chunk`` bytes, read in stretches of ``split`` bytes by as many tasks."""

    @classmethod
    def name(cls) -> str:
        return "blob_chunks"

    def schema(self) -> str:
        return "path string, offset long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options)


def blob_chunks(spark: SparkSession, path: str, *, chunk: int = 1 << 20, split: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(BlobChunks)
    return spark.read.format("blob_chunks").option("chunk", chunk).option("split", split).load(path)
