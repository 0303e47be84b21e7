"""Tables whose writes are listed in a log.

Rows go to a folder of their own, and count once a log entry names it.  An entry is a file that is created exclusively, under the next free number, so that of two
writers one takes the number and the other sees it; it holds the number of rows and a digest of their keys, which the write itself has counted.  What a run that
failed has left behind is named by no entry, and is never read.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_ENTRY = "kind string, folder string, rows long, digest string, base int"


class Conflict(RuntimeError):
    """Another writer has changed the table since it was looked at."""


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not exist; whether it didn't."""
    local = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    if "://" not in local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        # The entry is complete before it gets its name, and the name is given only if it is free.
        draft = f"{os.path.dirname(os.path.dirname(local))}/_draft-{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
        return True
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = store.create(where, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class Commits:
    def __init__(self, spark: SparkSession, path: str, *, key: list[str] | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def entries(self) -> list[dict]:
        """The log from its last replacement on, oldest first; a row per write."""
        try:
            log = self.spark.read.schema(_ENTRY).json(f"{self.path}/log").select("*", F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("int").alias("version"))
        except AnalysisException:
            return []
        found = [r.asDict() for r in log.where("folder IS NOT NULL").orderBy("version").collect()]
        last = max((i for i, r in enumerate(found) if r["kind"] == "replace"), default=0)
        return found[last:]

    def version(self) -> int:
        return max((r["version"] for r in self.entries()), default=0)

    def rows(self) -> int:
        """How many rows the table has, by its log."""
        return sum(r["rows"] for r in self.entries())

    def read(self) -> DataFrame | None:
        """All rows that count, or None before the first write."""
        folders = [f"{self.path}/data/{r['folder']}" for r in self.entries()]
        return self.spark.read.parquet(*folders) if folders else None

    def _written(self, df: DataFrame) -> dict:
        folder, seen = uuid.uuid4().hex, Observation()
        digest = F.coalesce(F.sum(F.xxhash64(*(self.key or df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        df.observe(seen, F.count(F.lit(1)).alias("rows"), digest.cast("string").alias("digest")).write.parquet(f"{self.path}/data/{folder}")
        return {"folder": folder, "rows": seen.get["rows"], "digest": seen.get["digest"]}

    def append(self, df: DataFrame) -> int:
        """Adds rows, whatever other writers add meanwhile; gives the version."""
        entry = {"kind": "append", **self._written(df)}
        version = self.version() + 1
        while not _create(self.spark, f"{self.path}/log/{version:020d}.json", json.dumps(entry)):
            version += 1
        return version

    def replace(self, df: DataFrame, *, base: int | None = None) -> int:
        """Puts rows in the place of all that were there at version ``base`` (by default now); Conflict if another writer came first."""
        base = self.version() if base is None else base
        entry = {"kind": "replace", "base": base, **self._written(df)}
        if not _create(self.spark, f"{self.path}/log/{base + 1:020d}.json", json.dumps(entry)):
            raise Conflict(f"{self.path}: version {base + 1} is another writer's")
        return base + 1

    def append_missing(self, todo: DataFrame) -> int:
        """Appends what isn't there by key.  Two writers of the same rows: the one that comes second finds the log moved on, and looks again."""
        while True:
            base, done = self.version(), self.read()
            rest = todo if done is None else todo.join(done.select(*self.key).distinct(), self.key, "left_anti")
            entry = {"kind": "append", "base": base, **self._written(rest)}
            if not entry["rows"] and done is not None:
                return base
            if _create(self.spark, f"{self.path}/log/{base + 1:020d}.json", json.dumps(entry)):
                return base + 1
