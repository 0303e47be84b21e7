"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded (its character classes, word shapes,
repetition and hashed words, through a learnt layer), gated attention weighs the passages, and the weighted
sum is scored.  Only documents are labelled; the attention weights are learnt from these labels.

The model is fitted on a bounded sample of labelled documents (``SAMPLE`` of them, with all their passages, as many as fit into ``SAMPLE_BYTES``).  Scoring takes all
passages of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .langid import held_out

PASSAGE = 50
SAMPLE = 3000
#: Bytes of the texts learnt from (their features take about as much); texts up to ``MODERATE_BYTES`` come first.
SAMPLE_BYTES, MODERATE_BYTES = 32 << 20, 256 << 10
HASHED = 64
ENCODED, ATTENTION = 32, 16
EPOCHS, BATCH, RATE, DECAY = 25, 64, 0.01, 1e-4
#: A document is predicted to be good from this score on.
GOOD_FROM = 0.7

_MARKS = b".,!?#$%&*|\n-:;'\""
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x80:] = 4
_CLASS[[0x20, 9, 13, 11, 12]] = 5
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = 6 + _i
_CLASSES = 6 + len(_MARKS)
WIDTH = _CLASSES + 6 + HASHED


def _repeated(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries come again within the same owner (all but the first)."""
    order = np.lexsort((np.arange(len(h)), h, owner))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (owner[order][1:] == owner[order][:-1]) & (h[order][1:] == h[order][:-1])
    return again


def encode(col: tk.Column, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of a group of texts, and where each text's passages begin.  A text without a
    word is one passage of zeros."""
    size = np.diff(w.first)
    parts = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(parts)])
    n = int(first[-1])
    out = np.zeros((n, WIDTH), np.float32)
    if not len(w.h):
        return out, first
    doc = w.doc
    passage = first[doc] + (np.arange(len(w.h)) - w.first[doc]) // PASSAGE
    lo, hi = int(col.offsets[w.lo]), int(col.offsets[w.hi])
    head = np.flatnonzero(np.diff(passage, prepend=-1))
    begin = w.start[head].copy()
    new = doc[head] != np.concatenate([[-1], doc[head][:-1]])
    begin[new] = col.offsets[w.lo + doc[head][new]]
    end = np.append(begin[1:], hi)
    last = np.append(new[1:], True)
    end[last] = col.offsets[w.lo + doc[head][last] + 1]
    which = np.repeat(passage[head], end - begin)
    at = np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange(len(which))
    kinds = np.bincount(which * _CLASSES + _CLASS[col.data[at]], minlength=n * _CLASSES).reshape(n, _CLASSES)
    length = np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    out[:, :_CLASSES] = np.sqrt(kinds / length)
    count = np.bincount(passage, minlength=n)
    some = np.maximum(count, 1)
    letters = (w.end - w.start).astype(float)
    out[:, _CLASSES] = np.log1p(count)
    out[:, _CLASSES + 1] = np.bincount(passage, letters, n) / some / 10
    out[:, _CLASSES + 2] = np.bincount(passage, letters > 12, n) / some
    out[:, _CLASSES + 3] = np.bincount(passage, _repeated(passage, w.h), n) / some
    starts = tk.gram_starts(w.first, 4)
    if len(starts):
        again = _repeated(doc[starts], tk.grams(w.h, 4)[starts])
        out[:, _CLASSES + 4] = np.bincount(passage[starts], again, n) / some
    out[:, _CLASSES + 5] = np.repeat(np.log1p(size), parts) / 5
    words = np.bincount(passage * HASHED + (w.h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    out[:, _CLASSES + 6 :] = np.sqrt(words / some[:, None])
    return out, first


class GatedAttention:
    """Encoder, gated attention and score: h = tanh(x A), weight = softmax(w . (tanh(h V) * sigmoid(h U))),
    score = sigmoid(c . sum(weight * h) + b)."""

    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"A": r.normal(0, WIDTH**-0.5, (WIDTH, ENCODED)), "a": np.zeros(ENCODED), "V": r.normal(0, ENCODED**-0.5, (ENCODED, ATTENTION)), "U": r.normal(0, ENCODED**-0.5, (ENCODED, ATTENTION)), "w": r.normal(0, 0.1, ATTENTION), "c": r.normal(0, 0.1, ENCODED), "b": np.zeros(1)}

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ p["A"] + p["a"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        weight = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(weight[:, None] * h, first[:-1], axis=0)
        return {"bag": bag, "h": h, "t": t, "s": s, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-(z @ p["c"] + p["b"])))}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, first)["score"]

    def _gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, first)
        bag, h, t, s, weight = (f[k] for k in ("bag", "h", "t", "s", "weight"))
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * p["c"]
        dh = weight[:, None] * dz[bag]
        dw = (h * dz[bag]).sum(axis=1)
        de = weight * (dw - np.add.reduceat(weight * dw, first[:-1])[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh += dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h * h)
        return {"A": x.T @ du, "a": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 0) -> GatedAttention:
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(axis=0), everything.std(axis=0) + 0.05
        bags = [(b - self.mean) / self.scale for b in bags]
        share = float(np.clip(y.mean(), 0.01, 0.99))
        self.p["b"][:] = np.log(share / (1 - share))
        r, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(EPOCHS):
            for at in np.array_split(r.permutation(len(bags)), max(1, len(bags) // BATCH)):
                step += 1
                g = self._gradient(np.concatenate([bags[i] for i in at]), np.concatenate([[0], np.cumsum([len(bags[i]) for i in at])]), y[at])
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] * (1 - RATE * DECAY) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = tk.column(batch.column(1))
        bags = []
        for w in tk.words(col, tk.SPACED):
            x, first = encode(col, w)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                bags.append(x[a:b].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary()), batch.column(2)], names=["doc_id", "bag", "label"])


def learn(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> GatedAttention | None:
    """Fits the model on the ``sample`` labelled documents that come first by a hash of their id, none of them held out; of these on those whose
    whole texts fit into ``SAMPLE_BYTES``, long ones last."""
    named = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out("doc_id"))
    chosen = named.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    every = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # At most ``sample`` sizes, of each id the largest; the texts are fetched afterwards.
    sizes = every.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("size").alias("size"))
    order = Window.orderBy(F.col("size") > MODERATE_BYTES, F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = sizes.withColumn("total", F.sum("size").over(order)).where(F.col("total") <= SAMPLE_BYTES).select("doc_id", "label")
    rows = every.join(F.broadcast(chosen), "doc_id")
    # Of several rows with a labelled id one is learnt from.
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    rows = sorted(rows.mapInArrow(_bags, "doc_id long, bag binary, label int").collect(), key=lambda r: (r.doc_id, bytes(r.bag)))
    if not rows:
        return None
    return GatedAttention().fit([np.frombuffer(r.bag, "<f4").reshape(-1, WIDTH).astype(float) for r in rows], np.array([float(r.label > 0) for r in rows]))


def score_quality(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text is scored as one passage without words.  Where nothing can be learnt (no labelled rows)
    every score is 0.5.  Labels without an id or value are left out; of several labels of an id the largest counts.
    Repeated rows are scored each on its own; other columns are never an input.
    """
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, doc_id=doc_id, text=text, label=label, sample=sample))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = tk.column(batch.column(2))
            for w in tk.words(col, tk.SPACED):
                n = w.hi - w.lo
                score = np.full(n, 0.5) if model.value is None else model.value.score(*encode(col, w))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, n), batch.column(1).slice(w.lo, n), pa.array(score.astype(float)), pa.array((score >= GOOD_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
