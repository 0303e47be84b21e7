"""Sends packed arrays through a shuffle.

Millions of hashes cost far less as a few binary arrays per task than as rows.  A task sorts its entries by
cell (a range of the hash), and sends one row of arrays per cell; equal hashes always meet in one partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import mix as tk_mix


def cells(df: DataFrame) -> int:
    """Partitions of an exchange of what is scanned from ``df``: as many as it has itself, or as the session's setting."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cell_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def packed(kind: int, cell: np.ndarray, columns: list[np.ndarray], width: int) -> pa.RecordBatch:
    """A row for each cell: cell, kind, and the binary arrays of its entries (unused columns are null)."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    cut = np.flatnonzero(np.diff(cell)) + 1
    begin, end = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(cell)]]).astype(int)
    if not len(cell):
        begin = end = np.empty(0, int)
    arrays = [pa.array(cell[begin] if len(cell) else np.empty(0, np.int32)), pa.array(np.full(len(begin), kind, np.int8))]
    for c in columns:
        c = np.ascontiguousarray(c[order])
        arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()))
    arrays += [pa.nulls(len(begin), pa.binary())] * (width - len(columns))
    return pa.RecordBatch.from_arrays(arrays, names=["cell", "kind", *(f"c{i}" for i in range(width))])


def schema(width: int) -> str:
    return "cell int, kind byte" + "".join(f", c{i} binary" for i in range(width))


def exchanged(sent: DataFrame, n: int, reduce: Callable[[dict[int, list[list[bytes]]]], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """Brings equal cells together and gives each partition's arrays, by kind, to ``reduce``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for kind, *values in zip(*columns, strict=True):
                kinds.setdefault(kind, []).append(values)
        if kinds:
            yield from reduce(kinds)

    return sent.repartition(n, F.col("cell")).mapInArrow(gather, out)


def array_of(rows: list[list[bytes]], i: int, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[i] for r in rows), dtype) if rows else np.empty(0, dtype)


def home(doc: np.ndarray, n: int) -> np.ndarray:
    """The cell to which everything about a document goes."""
    return (tk_mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int32)


def gathered(found: DataFrame, n: int, types: list[type], finish: Callable[[np.ndarray, list[np.ndarray]], pa.RecordBatch], out: str) -> DataFrame:
    """Brings what cells found out about documents (packed arrays: document ids, then values) to the documents' own
    cells.  ``finish`` gets all of a cell's entries, sorted by document."""

    def reduce(kinds: dict[int, list[list[bytes]]]) -> Iterator[pa.RecordBatch]:
        rows = [r for k in sorted(kinds) for r in kinds[k]]
        doc = array_of(rows, 0, np.int64)
        order = np.argsort(doc, kind="stable")
        values = [array_of(rows, i + 1, t)[order] for i, t in enumerate(types)]
        if len(doc):
            yield finish(doc[order], values)

    return exchanged(found, n, reduce, out)
