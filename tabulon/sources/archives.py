"""Zip and tar archives of any size, read member by member.

What an archive holds is read first, by seeking: a zip's directory, a tar's headers.  Members are then dealt out like rows, whatever archive they lie in, and read
by seeking to them; a member goes by chunks into lines, or is parsed whole if it is one JSON document.  A compressed tar can't be entered in the middle, and is
read by one task from front to back.
"""

from __future__ import annotations

import json
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import BATCH_BYTES, _opened

_MEMBERS = "path string, place long, member string, offset long, size long"


def _listed(path: str, file) -> Iterator[tuple]:
    """place, member, offset of its data or header (-1: only from front to back), size."""
    if zipfile.is_zipfile(file):
        with zipfile.ZipFile(file) as z:
            yield from ((i, m.filename, m.header_offset, m.file_size) for i, m in enumerate(z.infolist()) if not m.is_dir())
        return
    file.seek(0)
    with tarfile.open(fileobj=file) as t:
        plain = isinstance(t.fileobj, type(file))
        yield from ((i, m.name, m.offset_data if plain else -1, m.size) for i, m in enumerate(t) if m.isfile())


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """path, place, member, offset, size of all files in archives; their contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column("path").to_pylist():
                with _opened(where) as file:
                    rows = list(_listed(where, file))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                for low in range(0, len(rows), 10_000):
                    part = rows[low : low + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(part), pa.string()), *[pa.array([r[k] for r in part], t) for k, t in enumerate(types)]], names=["path", "place", "member", "offset", "size"])

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(members, _MEMBERS)


def _streams(rows: list[tuple[str, int, str, int, int]]) -> Iterator[tuple]:
    """(path, place, member, file) of members, in the order of their archives and places."""
    rows = sorted(rows)
    while rows:
        path = rows[0][0]
        own = [r for r in rows if r[0] == path]
        rows = rows[len(own) :]
        with _opened(path) as file:
            if zipfile.is_zipfile(file):
                with zipfile.ZipFile(file) as z:
                    found = z.infolist()
                    for _, place, member, _, _ in own:
                        with z.open(found[place]) as stream:
                            yield path, place, member, stream
            elif own[0][3] >= 0:
                for _, place, member, offset, size in own:
                    yield path, place, member, _Window(file, offset, size)
            else:
                wanted = {r[1]: r[2] for r in own}
                file.seek(0)
                with tarfile.open(fileobj=file, mode="r|*") as t:
                    for i, m in enumerate(t):
                        if i in wanted:
                            yield path, i, wanted[i], t.extractfile(m)


class _Window:
    """A stretch of a file, read from its beginning."""

    def __init__(self, file, offset: int, size: int):
        self.file, self.left = file, size
        file.seek(offset)

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


def _lines(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(chunk):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _values(member: str, stream) -> Iterator[str]:
    if member.endswith((".jsonl", ".ndjson")):
        yield from (line.decode() for line in _lines(stream) if line.strip())
        return
    value = json.loads(stream.read())
    for v in value if isinstance(value, list) else [value]:
        yield json.dumps(v)


def archived_json(spark: SparkSession, path: str, suffix: str | tuple[str, ...] = (".json", ".jsonl", ".ndjson")) -> DataFrame:
    """path, member, value (JSON text) of the JSON members of archives: a row per line of JSON lines, per entry of a list, or one.  Tasks get members, not
    archives, and hand rows on some 16 MB at a time."""
    ends = suffix if isinstance(suffix, tuple) else (suffix,)
    keep = F.lit(False)
    for e in ends:
        keep = keep | F.endswith("member", F.lit(e))
    found = archive_members(spark, path).where(keep)
    # What can't be entered in the middle stays together: one task reads it from front to back.
    # The number of tasks is given: by the size of their list they would be put together.
    dealt = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", F.when(F.col("offset") >= 0, F.col("place")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        out, size = ([], [], []), 0
        for where, _, member, stream in _streams(rows):
            for value in _values(member, stream):
                for column, x in zip(out, (where, member, value), strict=True):
                    column.append(x)
                size += len(value)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["path", "member", "value"])
                    out, size = ([], [], []), 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["path", "member", "value"])

    return dealt.mapInArrow(read, "path string, member string, value string")


def write_zips(rows: DataFrame, folder: str, member: str, text: str) -> DataFrame:
    """Writes rows as members (name, text) of zip files in a shared local folder, one for each partition; gives archive, members.  An archive gets its name once it is whole, so
    that a task may be tried again."""
    target = "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder
    numbered = rows.select(F.spark_partition_id().alias("part"), F.col(member).alias("member"), F.col(text).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(target, exist_ok=True)
        z, n, part, draft = None, 0, 0, ""
        for batch in batches:
            for r in batch.to_pylist():
                if z is None:
                    part, draft = r["part"], f"{target}/.draft-{r['part']}-{os.getpid()}"
                    z = zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED)
                z.writestr(r["member"], r["text"])
                n += 1
        if z is not None:
            z.close()
            os.replace(draft, f"{target}/part-{part:05d}.zip")
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}.zip"]), pa.array([n], pa.int64())], names=["archive", "members"])

    return numbered.mapInArrow(write, "archive string, members long")
