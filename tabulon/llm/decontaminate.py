"""Benchmark decontamination: scan whole texts for the word windows of test items.

The windows of all items (ten words; a shorter item is one window) form a hash set that is broadcast.
Training texts are scanned once; a position whose window hash is in the set is verified against the
item's words, and every word inside a verified occurrence is hit.

The set is a few arrays: items as numbers of their distinct words, and per distinct window its hash, a place where it stands and its items; about
``WINDOW_BYTES`` bytes a word of the items, and each distinct word once.  It is broadcast only while that stays below ``SET_BYTES``.  Beyond it the items
are processed in successive slices of that size, one at a time: each is collected, broadcast, scanned for, and given up before the
next.  Long items are cut into parts that overlap by a window less one word, so a slice is bounded whatever the items are.
Rows are numbered once, and the slices' spans merged by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

WINDOW = 10
#: The set is broadcast up to this size, as it lies in memory.
SET_BYTES = 96 << 20
#: Bytes of the set for a word of an item (a window begins with it: hash, place, items; and its number), for a distinct word, and for a part.
WINDOW_BYTES, WORD_BYTES, PART_BYTES = 28, 16, 16
#: Words of an item that are held together.
PART_WORDS = 50_000
#: Pairs of a document and an item that are held before equal ones are folded.
PAIRS = 1 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _run(keys: np.ndarray) -> int:
    """The longest run of equal sorted keys (1 unless hashes collide)."""
    return int(np.diff(np.flatnonzero(np.diff(keys)) + 1, prepend=0, append=len(keys)).max()) if len(keys) else 1


class Windows:
    """The distinct windows of one length: hash, a place where each stands, and its items."""

    def __init__(self, codes: np.ndarray, hashes: np.ndarray, place: np.ndarray, item: np.ndarray, size: int) -> None:
        g = tk.grams(hashes, size)[place]
        order = np.lexsort((place, item, g))
        g, place, item = g[order], place[order], item[order]
        other = np.ones(len(g), bool)
        other[1:] = g[1:] != g[:-1]
        for j in range(size):
            other[1:] |= codes[place[1:] + j] != codes[place[:-1] + j]
        kept = other.copy()
        kept[1:] |= item[1:] != item[:-1]
        self.size, self.keys, self.place, self.who = size, g[other], place[other].astype(np.int32), item[kept].astype(np.int32)
        self.first = np.append(np.flatnonzero(other[kept]), kept.sum()).astype(np.int32)
        self.run = _run(self.keys)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.place.nbytes + self.who.nbytes + self.first.nbytes


class WindowSet:
    """The hash set of the items' windows, by window length.  ``parts`` has the columns i (an item's id or null) and t (words joined by one
    space, none empty)."""

    def __init__(self, parts: pa.Table, window: int = WINDOW) -> None:
        ids, texts = (parts.column(k).cast(pa.string()).combine_chunks() for k in ("i", "t"))
        split = pc.split_pattern(texts, " ")
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        named = pc.list_flatten(split).dictionary_encode()
        del split
        hashes = np.concatenate([np.empty(0, np.uint64), *(w.h for w in tk.words(tk.column(named.dictionary), tk.ALNUM_FOLDED))])
        # Words are numbered in the order of their hashes, items in that of their names (one without an id comes first).
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.codes = rank[named.indices.to_numpy(zero_copy_only=False)]
        self.words, self.word_keys = tk.column(named.dictionary.take(pa.array(order))), hashes[order]
        self.word_run = _run(self.word_keys)
        named = ids.dictionary_encode(null_encoding="encode")
        order = pc.array_sort_indices(named.dictionary, null_placement="at_start") if len(ids) else pa.array([], pa.int64())
        self.names = named.dictionary.take(order)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order))
        item = rank[named.indices.to_numpy(zero_copy_only=False)]
        count, own = np.diff(first), self.word_keys[self.codes]
        self.by_size = []
        for size in np.unique(np.minimum(count, window)).tolist():
            place = tk.gram_starts(first, window) if size == window else first[:-1][count == size]
            self.by_size.append(Windows(self.codes, own, place, item[np.searchsorted(first, place, "right") - 1], size))

    @property
    def nbytes(self) -> int:
        return self.codes.nbytes + self.words.data.nbytes + self.words.offsets.nbytes + self.word_keys.nbytes + self.names.nbytes + sum(x.nbytes for x in self.by_size)

    def _numbers(self, col: tk.Column, w: tk.Words, at: np.ndarray) -> np.ndarray:
        """The numbers of these words of a text, compared byte by byte; -1 for a word that no item has."""
        h, out = w.h[at], np.full(len(at), -1, np.int32)
        low = np.searchsorted(self.word_keys, h)
        for k in range(self.word_run):
            code = np.minimum(low + k, len(self.word_keys) - 1)
            length = self.words.offsets[code + 1] - self.words.offsets[code]
            i = np.flatnonzero((out < 0) & (self.word_keys[code] == h) & (length == w.end[at] - w.start[at]))
            length, code = length[i], code[i]
            step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            apart = _FOLD[col.data[np.repeat(w.start[at[i]], length) + step]] != self.words.data[np.repeat(self.words.offsets[code], length) + step]
            good = np.bincount(np.repeat(np.arange(len(i)), length)[apart], minlength=len(i)) == 0
            out[i[good]] = code[good]
        return out

    def occurrences(self, col: tk.Column, w: tk.Words) -> Iterator[tuple[np.ndarray, Windows, np.ndarray]]:
        """Verified occurrences: word positions, and the window that stands at each."""
        for own in self.by_size:
            starts = tk.gram_starts(w.first, own.size)
            if not len(starts):
                continue
            g = tk.grams(w.h, own.size)[starts]
            low = np.searchsorted(own.keys, g)
            hit = np.flatnonzero(own.keys[np.minimum(low, len(own.keys) - 1)] == g)
            if not len(hit):
                continue
            at, g, low = starts[hit], g[hit], low[hit]
            number = np.full(len(w.h), -1, np.int32)
            inside = np.flatnonzero(tk.covered(len(w.h), at, own.size))
            number[inside] = self._numbers(col, w, inside)
            for k in range(own.run):
                which = np.minimum(low + k, len(own.keys) - 1)
                same = own.keys[which] == g
                for j in range(own.size):
                    same &= number[at + j] == self.codes[own.place[which] + j]
                if same.any():
                    yield at[same], own, which[same]

    def items(self, n: int, found: list[tuple[np.ndarray, Windows, np.ndarray]]) -> pa.ListArray:
        """The names of the items found in each of n texts, sorted; ``found`` has texts and the windows in them."""
        width, pairs = max(len(self.names), 1), [np.empty(0, np.int64)]
        for text, own, which in found:
            key = np.unique(text.astype(np.int64) * len(own.keys) + which)
            text, which = key // len(own.keys), key % len(own.keys)
            many = (own.first[which + 1] - own.first[which]).astype(np.int64)
            for a, b in tk.groups(tk.Column(key, np.concatenate([[0], np.cumsum(many)])), PAIRS):
                m = many[a:b]
                at = np.repeat(own.first[which[a:b]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                pairs.append(np.unique(np.repeat(text[a:b], m) * width + own.who[at]))
                if len(pairs) == 16:
                    pairs = [np.unique(np.concatenate(pairs))]
        every = np.unique(np.concatenate(pairs))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(every, np.arange(n + 1) * width), pa.int32()), self.names.take(pa.array(every % width)))


def _parts(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items in normal form, long ones in overlapping parts with the same windows."""
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = _WORD.findall(raw.encode().lower())
                step = max(PART_WORDS, window)
                texts = [b" ".join(parts[a : a + step + window - 1]).decode() for a in range(0, max(len(parts) - window + 1, 1), step)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["i", "t"])

    return cut


def _slices(benchmark: DataFrame, item: str, text: str, limit: int, window: int) -> Iterator[pa.Table]:
    """The items in tables whose window set stays below the limit, one at a time; an item without an id is an item of its own."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").mapInArrow(_parts(window), "i string, t string").where("t <> ''")
    words = F.length("t") - F.length(F.translate("t", " ", "")) + 1
    size = words * (WINDOW_BYTES + WORD_BYTES) + F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + PART_BYTES
    total = rows.select(F.sum(size.cast("long"))).first()[0] or 0
    n = int(total // limit) + 1
    n = 1 if n == 1 else 2 * n
    cut = rows.withColumn("s", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for k in range(n):
        yield cut.where(F.col("s") == k).select("i", "t").toArrow()


def hit_spans(documents: DataFrame, shared: Broadcast[WindowSet], doc_id: str, text: str) -> DataFrame:
    """Per document: its number of words, the merged hit spans [from, to) in words, and the items found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = tk.column(batch.column(1))
            for w in tk.words(col, tk.ALNUM_FOLDED):
                n = w.hi - w.lo
                mark, found = np.zeros(len(w.h) + 1, np.int64), []
                for at, own, which in shared.value.occurrences(col, w):
                    mark += np.bincount(at, minlength=len(mark)) - np.bincount(at + own.size, minlength=len(mark))
                    found.append((np.searchsorted(w.first, at, "right") - 1, own, which))
                hit = np.cumsum(mark[:-1]) > 0
                edge = hit.copy()
                inner = w.first[:-1][(w.first[:-1] > 0) & (w.first[:-1] < len(hit))]
                edge[1:] &= ~hit[:-1]
                edge[inner] = hit[inner]
                last = hit.copy()
                last[:-1] &= ~hit[1:]
                last[inner - 1] = hit[inner - 1]
                a, b = np.flatnonzero(edge), np.flatnonzero(last) + 1
                begin = w.first[np.searchsorted(w.first, a, "right") - 1]
                spans = pa.StructArray.from_arrays([pa.array(a - begin, pa.int64()), pa.array(b - begin, pa.int64())], names=["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.lo, n), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(np.searchsorted(a, w.first), pa.int32()), spans), shared.value.items(n, found)],
                    names=["doc_id", "n_words", "spans", "items"],
                )

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"
    )


def _merged(spans) -> object:
    """Spans of several slices, sorted, as their union."""
    return F.aggregate(
        F.array_sort(F.flatten(spans)),
        F.array().cast("array<struct<a:long,b:long>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(done, F.array(s))),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans (hit word ranges), items (ids as strings, sorted).

    A null or empty text has no words and no hits; a null or empty item has no window.  Repeated rows are
    scanned each on its own.  Repeated items count once per item id; an item without an id counts, but has no name.
    Other columns are ignored.
    """
    sc, parts = documents.sparkSession.sparkContext, _slices(benchmark, item_id, item_text, set_bytes, window)
    part, more = next(parts), next(parts, None)
    if more is None:
        return hit_spans(documents, sc.broadcast(WindowSet(part, window)), doc_id, text)
    # Fixed by the checkpoint: every scan sees the same numbers.
    keyed = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    rows = None
    for own in chain((part, more), parts):
        shared = sc.broadcast(WindowSet(own, window))
        found = hit_spans(keyed, shared, "row", "text")
        found = (found if rows is None else found.where("size(items) > 0")).checkpoint()
        shared.unpersist()
        rows = found if rows is None else rows.unionByName(found)
    merged = rows.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), _merged(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    by_name = F.concat(F.filter("items", lambda x: x.isNull()), F.array_sort(F.array_compact("items")))
    return keyed.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", "spans", by_name.alias("items"))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    return result.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_benchmark(documents: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents in which no window of a test item occurs, with all their columns."""
    window = kw.get("window", WINDOW)
    for part in _slices(benchmark, kw.get("item_id", "item_id"), kw.get("item_text", "text"), kw.get("set_bytes", SET_BYTES), window):
        documents = _without(documents, WindowSet(part, window), kw.get("text", "text"))
    return documents


def _without(documents: DataFrame, windows: WindowSet, text: str) -> DataFrame:
    """The rows without an occurrence; whole rows pass through the scan, so each goes by its own text, whatever its id."""
    shared = documents.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = tk.column(batch.column(0))
            clean = np.ones(batch.num_rows, bool)
            for w in tk.words(col, tk.ALNUM_FOLDED):
                for at, _, _ in shared.value.occurrences(col, w):
                    clean[w.lo + np.searchsorted(w.first, at, "right") - 1] = False
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(clean))

    return documents.select(F.col(text).cast("string").alias("_text"), "*").mapInArrow(scan, documents.schema)

