"""Best-fit decreasing packing of token sequences.

Texts are tokenized where they lie; longer ones are cut into pieces of the capacity.  Best-fit decreasing
only depends on the lengths, and there are at most ``capacity`` different ones, so the driver packs a
histogram: for each length, longest first, a segment tree over remaining capacities finds the tightest open
sequences, and whole ranges of sequences with equal room are filled at once.  This gives exactly the
packing of the whole corpus by best-fit decreasing, from a table whose size does not grow with it.
The result is a list of runs (length, ranks, sequences); each piece finds its place by its rank among
the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from . import wordbpe

CAPACITY = 4096
END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class RoomTree:
    """A segment tree over remaining capacities: is any sequence open that has exactly this much room?"""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, value: bool) -> None:
        i = room + self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some open sequence has."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of a packing, sorted by (length, first rank): columns length, first rank, pieces, first
    sequence, pieces per sequence, first offset.  Piece k of a run is in sequence first + k // per, at
    offset + (k % per) * length."""
    tree = RoomTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                per, first, n = min(capacity // length, left), sequences, left // min(capacity // length, left)
                sequences += n
                room = capacity
            else:
                first, have = open_[room].pop()
                per = min(room // length, left)
                n = min(have, left // per)
                if have > n:
                    open_[room].append((first + n, have - n))
                tree.set(room, bool(open_[room]))
            runs.append((length, rank, n * per, first, per, capacity - room))
            put(room - per * length, first, n)
            left -= n * per
            rank += n * per
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def tokenized(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, if asked for)."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        for batch in batches:
            col, docs = tk.column(batch.column(1)), batch.column(0).to_pylist()
            for w in tk.words(col, tk.SPACED):
                ids, counts = bpe.ids(col, w)
                ends = np.cumsum(counts).tolist()
                rows: list[list] = [[] for _ in range(6)]
                at = 0
                for d, end in enumerate(ends):
                    own = np.append(ids[at:end], np.uint32(END_ID)).astype("<u4").tobytes()
                    at = end
                    for piece, start in enumerate(range(0, len(own) // 4, capacity)):
                        raw = own[4 * start : 4 * (start + capacity)]
                        for out, x in zip(rows, (docs[w.lo + d], piece, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None), strict=True):
                            out.append(x)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)][: 5 + with_ids], names=names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def place(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length.

    Ranks within a length are counted per salt, so a length that a third of all pieces share is
    ranked in many tasks.  The histogram and the runs have a size bounded by the capacity alone.
    """
    pieces = pieces.checkpoint()
    salts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).checkpoint()
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = pieces.sparkSession.sparkContext.broadcast(best_fit_decreasing(histogram, capacity))
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))).join(before, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("k") - 1).alias("rank"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        keys = (r[:, 0].astype(np.uint64) << np.uint64(48)) + r[:, 1].astype(np.uint64)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = (t.column(x).to_numpy().astype(np.int64) for x in ("length", "rank"))
            i = np.searchsorted(keys, (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), "right") - 1
            k = rank - r[i, 1]
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(r[i, 3] + k // r[i, 4])).append_column("offset", pa.array(r[i, 5] + (k % r[i, 4]) * length))
            yield from t.to_batches()

    return ranked.mapInArrow(locate, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A null or empty text is one piece that holds the end id alone.  Repeated rows are packed each on its
    own, ties in length in order of (doc_id, piece).  An empty table gives no rows; other columns are ignored.
    """
    return place(tokenized(documents, doc_id=doc_id, text=text, tokenizer=tokenizer, capacity=capacity, with_ids=with_ids), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (binary).  At most ``capacity`` pieces meet in one."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda t, x: F.concat(t, x["ids"])).alias("ids"))
