"""Exact de-duplication by deterministic block naming.

A text (A-Z folded) is cut into blocks of ``BLOCK`` bytes.  Blocks are sorted, and equal blocks get
the same integer name; then adjacent names are paired, the pairs are sorted and named again, until each
text has a single name.  Names come from the order of the contents themselves, never from a hash: two texts
share the last name if and only if they are equal.

Sorting is spread over ``BUCKETS`` buckets chosen by a hash of the content (equal contents always meet in
one bucket), and a name is (bucket, rank in the bucket).  Equal texts that lie close together in the input
are folded into one representative before anything is shuffled, so a group of copies that holds a third of
all rows sends a row per input window, not a row per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from . import textkernel as tk

BLOCK = 4096
BUCKETS = 1 << 20
#: Bytes of distinct text within which equal texts are folded before the shuffle.
FOLD_BYTES = 24 << 20


def _representatives(block: int):
    schema = pa.schema([("uid", pa.int64()), ("idx", pa.int32()), ("n", pa.int32()), ("block", pa.binary()), ("members", pa.list_(pa.int64())), ("sha", pa.string()), ("raw", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33

        def flush(texts: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
            nonlocal uid
            rows: list[list] = [[] for _ in schema]
            size = 0
            for text, (members, best) in texts.items():
                n = max(1, -(-len(text) // block))
                members.sort(key=lambda x: (x is not None, x or 0), reverse=True)
                sha = hashlib.sha256(text).hexdigest()
                for i in range(n):
                    for out, x in zip(rows, (uid, i, n, text[i * block : (i + 1) * block], None if i else members, None if i else sha, None if i else best[2]), strict=True):
                        out.append(x)
                uid += 1
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, size = [[] for _ in schema], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

        texts: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            col, ids = tk.column(batch.column(1)), batch.column(0).to_pylist()
            for i, doc in enumerate(ids):
                raw = col.text(i)
                text = raw.lower()
                known = texts.get(text)
                if known is None:
                    texts[text] = [[doc], (doc is not None, doc or 0, hashlib.sha256(raw).hexdigest())]
                    held += len(text) + 200
                else:
                    known[0].append(doc)
                    held += 16
                    if (doc is not None, doc or 0) >= known[1][:2]:
                        known[1] = max(known[1], (doc is not None, doc or 0, hashlib.sha256(raw).hexdigest()))
                if held > FOLD_BYTES:
                    yield from flush(texts)
                    texts, held = {}, 0
        yield from flush(texts)

    return fold, "uid long, idx int, n int, block binary, members array<long>, sha string, raw string"


def _named(rows: DataFrame, content: list[str]) -> DataFrame:
    """Adds ``name``: equal contents get equal integers, different contents different ones."""
    bucket = F.pmod(F.xxhash64(*content), F.lit(BUCKETS))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*content))
    return rows.withColumn("bucket", bucket).withColumn("name", F.shiftleft("bucket", 32) + rank).drop("bucket", *content)


def identities(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per folded text: uid, members (document ids, largest first), sha (of the folded text), raw (of the
    first member's text as it stands), and its identity (level, name)."""
    fold, schema = _representatives(block)
    blocks = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(fold, schema)
    state = _named(blocks, ["block"]).checkpoint()
    heads = state.where("idx = 0").select("uid", "members", "sha", "raw")
    longest = state.agg(F.max("n")).first()[0] or 1
    state, done, level = state.select("uid", "idx", "n", "name"), None, 0
    while True:
        ended = state.where("n = 1").select("uid", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if longest <= 1:
            break
        pairs = state.where("n > 1").groupBy("uid", F.expr("idx div 2").cast("int").alias("half"), F.expr("(n + 1) div 2").cast("int").alias("n"))
        pairs = pairs.agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        # Each level is written, so a lost executor repeats one level and not all.
        state = _named(pairs.withColumnRenamed("half", "idx"), ["left", "right"]).checkpoint()
        longest, level = (longest + 1) // 2, level + 1
    return done.join(heads, "uid")


def _verdicts(documents: DataFrame, doc_id: str, text: str, block: int = BLOCK) -> DataFrame:
    """What ``exact_duplicates`` returns, and raw: the sha256 of a kept row's text as it stands."""
    named = identities(documents, doc_id=doc_id, text=text, block=block)
    group = named.groupBy("level", "name").agg(F.max(F.struct(F.col("members")[0].alias("id"), "raw", "uid")).alias("best"), F.sum(F.size("members")).cast("long").alias("group_size"))
    rows = named.join(group, ["level", "name"]).select("uid", "best", "group_size", "sha", F.posexplode("members").alias("pos", "doc_id"))
    return rows.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", ((F.col("uid") == F.col("best.uid")) & (F.col("pos") == 0)).alias("kept"), F.col("sha").alias("text_sha256"), F.col("best.raw").alias("raw"))


def exact_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical after folding A-Z.  Null counts as empty, and all empty texts are equal.  The
    largest doc_id of a group stays (a null id counts as the smallest); of repeated rows with that id
    exactly one is marked kept.  An empty table gives no rows; other columns are ignored.
    """
    return _verdicts(documents, doc_id, text, block).drop("raw")


def row_key(doc_id: str, text: str) -> dict[str, Column]:
    """Columns that tell a row's id (null too) and text: rows that agree in them hold the same id and text."""
    i = F.col(doc_id).cast("long")
    return {"_has": i.isNotNull(), "_id": F.coalesce(i, F.lit(0)), "_raw": F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)}


def first_of_equal(documents: DataFrame, key: list[str]) -> Column:
    """The place of a row among those that agree in the key, by its other columns."""
    other = [f.name for f in documents.schema if f.name not in key and isinstance(f.dataType, AtomicType)]
    return F.row_number().over(Window.partitionBy(*key).orderBy(*other))


def drop_exact(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row per group of equal texts, whatever ids repeat or lack."""
    key = row_key(doc_id, text)
    kept = _verdicts(documents, doc_id, text).where("kept").select((F.col("doc_id").isNotNull()).alias("_has"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("raw").alias("_raw"))
    own = documents.withColumns(key)
    own = own.withColumn("_k", first_of_equal(own, list(key))).where("_k = 1")
    return own.join(kept, list(key), "left_semi").select(*documents.columns)
