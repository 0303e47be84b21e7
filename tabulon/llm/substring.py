"""Substring de-duplication by level-wise doubling of word windows.

The first level looks at windows of a quarter of the minimum length, and of these only at anchors: a window that has the
smallest hash of its neighbourhood.  Every stretch of the minimum length contains an anchor, and equal
stretches contain equal anchors at the same place.  Only windows that occur more than once go on, to twice their length: a stretch of
the minimum length that holds such a window also holds the one that begins with it or the one that ends with it.  So the length is doubled until
the next one is the minimum itself; then all windows around those that survive are taken, and of equal ones every
one but the first is removed.  ``repeat_levels`` goes on doubling the windows that repeat until none survives.

Each task first settles the repeats among its own texts, so a window sends at most a row per block of text to
the shuffle, however many documents share it.  Windows of the minimum length are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkernel as tk

WINDOW = 20
#: Bytes of text whose repeats are settled within a task.
LOCAL_BYTES = 8 << 20
#: Document id of rows whose id is null: before all others.
_NULL_ID = np.int64(-(2**63))


def _blocks(batches: Iterator[pa.RecordBatch], *, second: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of about ``LOCAL_BYTES`` at a time, with their word hashes (and second ones) and where each text's words begin."""
    for batch in batches:
        for lo, hi in tk.groups(tk.column(batch.column(1)), LOCAL_BYTES):
            part = batch.slice(lo, hi - lo)
            found = list(tk.words(tk.column(part.column(1)), tk.SPACED, second=second))
            sizes = np.concatenate([np.diff(w.first) for w in found])
            yield part, np.concatenate([w.h for w in found]), np.concatenate([w.h2 for w in found]), np.concatenate([[0], np.cumsum(sizes)])


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column(0).fill_null(int(_NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def anchors(h: np.ndarray, first: np.ndarray, half: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of ``half`` words that are the smallest of some window of ``window`` words."""
    g, span = tk.grams(h, half), window - half + 1
    starts = tk.gram_starts(first, window)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low, width = g, 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    # Of all windows that hold a place, the largest of the smallest hashes: its own hash just when it is the smallest in one of them.
    most, width = np.zeros(len(g), np.uint64), 1
    most[starts] = low[starts]
    while width < span:
        step = min(width, span - width)
        most[step:] = np.maximum(most[step:], most[:-step])
        width += step
    at = np.flatnonzero((most == g) & (most > 0))
    return at, g[at]


def windows_around(at: np.ndarray, n: int, first: np.ndarray, half: int, window: int) -> np.ndarray:
    """Starts of the windows that contain one of the anchors."""
    begin = np.maximum(at - (window - half), 0)
    near = np.cumsum(np.bincount(begin, minlength=n + 2) - np.bincount(at + 1, minlength=n + 2)) > 0
    starts = tk.gram_starts(first, window)
    return starts[near[starts]]


def _rows(doc: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    """One row per document (they come sorted): its id and the bytes of the interleaved int32 values."""
    table = np.stack(values, axis=1).astype("<i4")
    cut = np.flatnonzero(np.diff(doc)) + 1
    begin, end = [0, *cut.tolist()], [*cut.tolist(), len(doc)]
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array([table[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())], names=["doc", "values"])


def _held_by(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, text, values of the documents that have candidates."""
    return docs.withColumn("key", F.coalesce("doc_id", F.lit(int(_NULL_ID)))).join(candidates, F.col("key") == F.col("doc")).select("doc_id", "text", "values")


def _positions(part: pa.RecordBatch, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a block's candidates of some length, and where their texts begin and end.  Of rows that share an id a shorter text
    may lack some."""
    found = [np.frombuffer(x, "<i4").astype(np.int64) for x in part.column(2).to_pylist()]
    at = np.concatenate([x + a for x, a in zip(found, first[:-1].tolist(), strict=True)])
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    real = at + length <= first[row + 1]
    return at[real], first[row[real]], first[row[real] + 1]


def repeated_anchors(docs: DataFrame, length: int, window: int) -> DataFrame:
    """doc, values: positions of the document's anchors of ``length`` words that occur more than once anywhere."""
    return _repeated(docs, lambda part, h, first: anchors(h, first, length, window))


def repeated_doubles(docs: DataFrame, candidates: DataFrame, length: int) -> DataFrame:
    """doc, values: positions of the windows of twice the length that begin or end with a candidate and occur more than once."""

    def doubles(part: pa.RecordBatch, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, begin, end = _positions(part, first, length)
        both = np.unique(np.concatenate([at[at + 2 * length <= end], (at - length)[at - length >= begin]]))
        return both, tk.grams(h, 2 * length)[both] if len(both) else np.empty(0, np.uint64)

    return _repeated(_held_by(docs, candidates), doubles)


def _repeated(docs: DataFrame, pick: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """doc, values: positions of the windows that ``pick`` takes from a block (with their hashes) and that occur more than once anywhere."""
    n = ex.cells(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, _, first in _blocks(batches):
            at, g = pick(part, h, first)
            if not len(at):
                continue
            row = np.searchsorted(first, at, "right") - 1
            doc, pos = _ids(part)[row], (at - first[row]).astype(np.int32)
            _, lead, which, count = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
            local = count[which] > 1
            once = lead[count == 1]
            yield ex.packed(0, ex.cell_of(g[once], n), [g[once], doc[once], pos[once]], 3)
            several = lead[count > 1]
            yield ex.packed(1, ex.cell_of(g[several], n), [g[several]], 3)
            yield ex.packed(2, ex.home(doc[local], n), [doc[local], pos[local]], 3)

    def reduce(kinds: dict[int, list[list[bytes]]]) -> Iterator[pa.RecordBatch]:
        one = kinds.get(0, [])
        g, doc, pos = ex.array_of(one, 0, np.uint64), ex.array_of(one, 1, np.int64), ex.array_of(one, 2, np.int32)
        known = ex.array_of(kinds.get(1, []), 0, np.uint64)
        _, which, count = np.unique(np.concatenate([g, known, known]), return_inverse=True, return_counts=True)
        again = count[which[: len(g)]] > 1
        two = kinds.get(2, [])
        doc, pos = np.concatenate([doc[again], ex.array_of(two, 0, np.int64)]), np.concatenate([pos[again], ex.array_of(two, 1, np.int32)])
        yield ex.packed(0, ex.home(doc, n), [doc, pos], 2)

    found = ex.exchanged(docs.mapInArrow(scan, ex.schema(3)), n, reduce, ex.schema(2))
    return ex.gathered(found, n, [np.int32], _rows, "doc long, values binary")


def repeated_windows(docs: DataFrame, candidates: DataFrame, half: int, window: int, *, first_too: bool = False) -> DataFrame:
    """doc, values: word ranges [from, to) of the windows that also start earlier (or, with ``first_too``, of
    all windows that occur more than once)."""
    n = ex.cells(docs)

    def intervals(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(doc):
            return doc, start.astype(np.int32), start.astype(np.int32)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
        begin = np.flatnonzero(head)
        return doc[begin], start[begin].astype(np.int32), (start[np.append(begin[1:], len(doc)) - 1] + window).astype(np.int32)

    def settle(g: np.ndarray, g2: np.ndarray, doc: np.ndarray, start: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
        """Order of the windows, which of them come later than an equal one, and which come first of several."""
        order = np.lexsort((start, doc, g2, g))
        g, g2, doc, start, twice = g[order], g2[order], doc[order], start[order], twice[order]
        head = np.ones(len(g), bool)
        head[1:] = (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])
        group = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        later = (doc != doc[at][group]) | (start != start[at][group])
        several = np.zeros(len(at), bool)
        np.logical_or.at(several, group, later | twice)
        return order, later, head, several[group]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, h2, first in _blocks(batches, second=True):
            w = windows_around(_positions(part, first, half)[0], len(h), first, half, window)
            if not len(w):
                continue
            g, g2 = tk.grams(h, window)[w], tk.grams(h2, window)[w]
            row = np.searchsorted(first, w, "right") - 1
            doc, start = _ids(part)[row], (w - first[row]).astype(np.int64)
            order, later, head, several = settle(g, g2, doc, start, np.zeros(len(g), bool))
            local = order[later | (head & several)] if first_too else order[later]
            if len(local):
                d, a, b = intervals(doc[local], start[local])
                yield ex.packed(1, ex.home(d, n), [d, a, b], 5)
            lead = order[head]
            yield ex.packed(0, ex.cell_of(g[lead], n), [g[lead], g2[lead], doc[lead], start[lead].astype(np.int32), several[head].astype(np.uint8)], 5)

    def reduce(kinds: dict[int, list[list[bytes]]]) -> Iterator[pa.RecordBatch]:
        one, two = kinds.get(0, []), kinds.get(1, [])
        g, g2, doc, start, twice = (ex.array_of(one, i, t) for i, t in enumerate((np.uint64, np.uint64, np.int64, np.int32, np.uint8)))
        order, later, head, several = settle(g, g2, doc, start, twice.astype(bool))
        mark = order[(head & several) | later] if first_too else order[later]
        d, a, b = intervals(doc[mark], start[mark].astype(np.int64))
        d, a, b = np.concatenate([d, ex.array_of(two, 0, np.int64)]), np.concatenate([a, ex.array_of(two, 1, np.int32)]), np.concatenate([b, ex.array_of(two, 2, np.int32)])
        yield ex.packed(0, ex.home(d, n), [d, a, b], 3)

    found = ex.exchanged(_held_by(docs, candidates).mapInArrow(scan, ex.schema(5)), n, reduce, ex.schema(3))
    return ex.gathered(found, n, [np.int32, np.int32], _rows, "doc long, values binary")


def _clean(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and the kept text, if asked for).

    Words lie between ASCII white space.  Each word that is covered by a window of ``window`` words which also
    starts earlier (in a document of a smaller id, or before in the same one) is removed; kept words are joined
    by one space.  Windows are judged on the input.  A null or empty text has no words, and the digest of the
    empty text.  A null id comes before all others; rows that share an id count as one place, so equal
    windows at the same place of such rows do not remove each other.  Other columns are ignored.
    """
    docs, length = _clean(documents, doc_id, text), max(1, window // 4)
    survivors = repeated_anchors(docs, length, window)
    while 2 * length < window:
        survivors, length = repeated_doubles(docs, survivors, length), 2 * length
    marks = repeated_windows(docs, survivors, length, window)
    rows = docs.withColumn("key", F.coalesce("doc_id", F.lit(int(_NULL_ID)))).join(marks, F.col("key") == F.col("doc"), "left").select("doc_id", "text", "values")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, out = tk.column(batch.column(1)), [[], [], [], []]
            for i, values in enumerate(batch.column(2).to_pylist()):
                own = kept = col.text(i).split()
                if values:
                    spans = np.frombuffer(values, "<i4").reshape(-1, 2)
                    spans = spans[spans[:, 1] <= len(own)]
                    kept = list(compress(own, (~tk.covered(len(own), spans[:, 0], spans[:, 1] - spans[:, 0])).tolist()))
                joined = b" ".join(kept)
                for x, y in zip(out, (len(own), len(own) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None), strict=True):
                    x.append(y)
            arrays = [batch.column(0), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: 4 + with_text], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def repeat_levels(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, at_least: int = 1) -> DataFrame:
    """For each length window, 2 window, 4 window, ... the documents with a window that occurs more than once
    anywhere: level, length, doc, values (word ranges).  Only such windows are extended to the next
    length; it ends when fewer than ``at_least`` documents have any."""
    docs = _clean(documents, doc_id, text)
    half, found, out, level = max(1, window // 2), None, None, 1
    while True:
        if found is None:
            candidates = repeated_anchors(docs, half, window)
        else:
            candidates = found.mapInArrow(_starts(half), "doc long, values binary")
        found = repeated_windows(docs, candidates, half, window, first_too=True).checkpoint()
        if found.count() < at_least:
            return out if out is not None else found.select(F.lit(level).alias("level"), F.lit(window).alias("length"), "doc", "values")
        here = found.select(F.lit(level).alias("level"), F.lit(window).alias("length"), "doc", "values")
        out = here if out is None else out.unionByName(here)
        half, window, level = window, 2 * window, level + 1


def _starts(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows of ``size`` words inside a document's ranges."""
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                spans = np.frombuffer(raw, "<i4").reshape(-1, 2).astype(np.int64)
                n = spans[:, 1] - spans[:, 0] - size + 1
                out.append(np.unique(np.repeat(spans[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc", "values"])

    return scan
