"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of its labelled texts.  A text is then
parsed against it: the longest stretch that occurs in the sample is a phrase, the next phrase starts
after it, and so on.  A phrase costs the bits that name a place in the sample, so phrases times the sample's
logarithm, over the text's length, estimate the text's entropy as that language sees it.  The language
that needs the fewest phrases, so normalised, wins; samples of different sizes don't favour the larger one.

Parsing is vectorised over stretches of ``STRETCH`` symbols, and the result is that of parsing each whole text in one go: every
stretch is first parsed as if a phrase began with it; then the parse of the stretch before is carried on into it until
both begin a phrase at the same place, from where on they agree.
A phrase that ends is folded into the table (a negative entry: count one, go on from the root's transition).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk

#: Labelled documents learnt from per language; texts up to so many bytes come first.
SAMPLE_DOCS, MODERATE_BYTES = 32, 8192
#: Bytes of the texts learnt from: of a language, and of all languages, which share them equally.  A text beyond its language's share is never learnt from.
LANGUAGE_BYTES, SAMPLE_BYTES = 192 << 10, 768 << 10
STRETCH = 512
#: Sharpness of the score: how a relative difference in phrases becomes odds.
SHARPNESS = 60.0
_SPACE = 0x20

_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ASCII letters folded, bytes beyond ASCII as they are, any run of other bytes a single space."""
    out = _FOLD[data]
    keep = np.ones(len(out), bool)
    if len(out):
        blank = out == _SPACE
        keep[1:] = ~(blank[1:] & blank[:-1])
        first = offsets[:-1][offsets[:-1] < len(out)]
        keep[first] = ~blank[first]
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[offsets]


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton, one row per state, -1 where there is none; state 0 is the root."""
    n = 2 * len(symbols) + 2
    table = np.full((n, alphabet), -1, np.int32)
    link, longest, size, last = [-1] * n, [0] * n, 1, 0
    rows: list[dict[int, int]] = [{}]
    for c in symbols:
        cur, size = size, size + 1
        rows.append({})
        longest[cur] = longest[last] + 1
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = rows[p][c]
            if longest[p] + 1 == longest[q]:
                link[cur] = q
            else:
                copy, size = size, size + 1
                rows.append(dict(rows[q]))
                longest[copy], link[copy] = longest[p] + 1, link[q]
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    state = np.repeat(np.arange(size), [len(r) for r in rows])
    symbol = np.fromiter((c for r in rows for c in r), np.int64, len(state))
    table[state, symbol] = np.fromiter((t for r in rows for t in r.values()), np.int64, len(state))
    return table[:size]


class Languages:
    """One parsing table per language."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.names = sorted(samples)
        seen = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8))
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = width = len(seen) + 1
        self.tables, self.bits = [], []
        for name in self.names:
            text = self.symbol[np.frombuffer(samples[name], np.uint8)].tolist()
            table = suffix_automaton(text, width)
            # One state more: before the first symbol, and after one that the sample lacks; whatever comes begins a phrase.
            void = len(table)
            restart = np.where(table[0] < 0, void, table[0])
            table = np.concatenate([table, np.full((1, width), -1, np.int32)])
            # An entry is the next state's row offset; where a phrase ends, the complement of the restart's.
            self.tables.append(np.where(table >= 0, table * width, ~(restart * width)[None, :]).astype(np.int32).ravel())
            self.bits.append(math.log2(max(2, len(text))))

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text, a column per language."""
        symbols, size = self.symbol[data], np.diff(offsets)
        parts = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(size)), parts)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offsets[:-1][owner] + index * STRETCH
        length = np.minimum(STRETCH, offsets[1:][owner] - start)
        # Lanes are the stretches, the longest first; all but a text's last are full.
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.where(index > 0, np.concatenate([[0], place[:-1]]), -1)[order] if len(order) else place
        start, length = start[order], length[order]
        out = np.zeros((len(size), len(self.names)))
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(owner[order], self._parse(table, symbols, start, length, follows), len(size))
        return out

    def _parse(self, table: np.ndarray, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that begin in each stretch; ``follows`` is the stretch before it in the same text, or -1."""
        n, void = len(start), np.int32(len(table) - self.width)
        state, begins = np.full(n, void, np.int32), np.zeros((STRETCH, n), bool)
        for t in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -t, "left"))
            to = table[state[:m] + symbols[start[:m] + t]]
            ended = to >> 31
            begins[t, :m] = ended
            np.bitwise_xor(to, ended, out=state[:m])
        count = begins.sum(axis=0)
        # Stretches whose true first state is known, and what it changes.
        lanes, ends = np.flatnonzero(follows >= 0), state.copy()
        carried = state[follows[lanes]]
        while len(lanes):
            apart, now, found = np.arange(len(lanes)), carried.copy(), np.zeros(len(lanes), np.int64)
            for t in range(STRETCH):
                apart = apart[length[lanes[apart]] > t]
                if not len(apart):
                    break
                to = table[now[apart] + symbols[start[lanes[apart]] + t]]
                ended = to >> 31
                now[apart] = to ^ ended
                found[apart] -= ended
                met = (ended < 0) & begins[t, lanes[apart]]
                done = apart[met]
                # From here on the first parse is right: what it began after this place counts.
                found[done] += begins[t + 1 :, lanes[done]].sum(axis=0)
                now[done] = ends[lanes[done]]
                apart = apart[~met]
            count[lanes] = found
            # Where the two never met, the stretch ends in another state, and the next one is carried on from that.
            changed = lanes[now != state[lanes]]
            state[lanes] = now
            lanes = np.flatnonzero(np.isin(follows, changed)) if len(changed) else changed
            carried = state[follows[lanes]]
        return count


def _training(documents: DataFrame, doc_id: str, text: str, label: str, held_out, sample: int) -> dict[str, bytes]:
    """At most ``sample`` whole texts per language, those of moderate length first, in the order of a hash of their id, as many of them as fit into
    the language's share of bytes."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null").where(~held_out)
    found: dict[str, bytes] = {}
    share = min(LANGUAGE_BYTES, SAMPLE_BYTES // max(1, rows.select("label").distinct().count()))
    rows = rows.where(F.octet_length("text") <= share)
    # Only ids are ranked, and every task passes on no more than its own first ones; the texts are fetched afterwards.
    key = F.struct((F.octet_length("text") > MODERATE_BYTES).alias("long"), F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"))
    near = Window.partitionBy("label").orderBy("key")
    ids = rows.select("label", key.alias("key"), F.octet_length("text").cast("long").alias("size")).withColumn("k", F.row_number().over(near)).where(F.col("k") <= sample)
    ids = ids.withColumn("total", F.sum("size").over(near.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= share)
    ids = ids.groupBy("label", "key").agg(F.min("k").alias("k"))
    chosen = rows.withColumn("key", key).join(F.broadcast(ids), ["label", "key"]).groupBy("label", "k").agg(F.min("text").alias("text"))
    for r in sorted(chosen.collect(), key=lambda r: (r.label, r.k)):
        raw = np.frombuffer(r.text.encode(), np.uint8)
        data, _ = normalised(raw, np.array([0, len(raw)]))
        found[r.label] = found.get(r.label, b"") + data.tobytes().strip() + b" "
    return {k: v for k, v in found.items() if v.strip()}


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _has_letter(col: tk.Column, lo: int, hi: int) -> np.ndarray:
    data, offs = col.data[col.offsets[lo] : col.offsets[hi]], col.offsets[lo : hi + 1] - col.offsets[lo]
    folded = _FOLD[data]
    ascii_letters, beyond = (np.concatenate([[0], np.cumsum(x)])[offs] for x in ((folded != _SPACE) & (folded < 0x80), folded >= 0x80))
    found = np.diff(ascii_letters) > 0
    for i in np.flatnonzero(~found & (np.diff(beyond) > 0)).tolist():
        found[i] = any(c.isalpha() for c in col.text(lo + i).decode("utf-8", "replace"))
    return found


def _model(documents: DataFrame, doc_id: str, text: str, label: str, sample: int):
    """The languages learnt from the documents, as a broadcast; None where there are none.  Its size is that of the sample, whatever the
    documents: about 500 bytes for each byte of the sampled texts, which ``SAMPLE_BYTES`` bounds."""
    samples = _training(documents, doc_id, text, label, held_out("doc_id"), sample)
    return documents.sparkSession.sparkContext.broadcast(Languages(samples) if samples else None)


def _judged(languages: Languages | None, col: tk.Column, sharpness: float) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """For each group of texts: its bounds, the languages, their scores, and the entropy that the winner sees."""
    for lo, hi in tk.groups(col, 4 * tk.GROUP_BYTES):
        n = hi - lo
        letters = _has_letter(col, lo, hi)
        names, score, share = ["und"] * n, np.zeros(n), np.zeros(n)
        if languages is not None:
            data, offs = normalised(col.data[col.offsets[lo] : col.offsets[hi]], col.offsets[lo : hi + 1] - col.offsets[lo])
            entropy = languages.phrases(data, offs) * np.array(languages.bits) / np.maximum(np.diff(offs), 1)[:, None]
            best, share = entropy.argmin(axis=1), entropy.min(axis=1)
            score = np.where(letters, 1 / np.exp(-sharpness * (entropy / np.maximum(share, 1e-9)[:, None] - 1)).sum(axis=1), 0.0)
            names = [languages.names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        yield lo, hi, names, score, share


def identify(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", learn_from: DataFrame | None = None, sharpness: float = SHARPNESS, sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, entropy (bits per byte of the normalised text, as the language that wins sees it).

    ``und`` with score 0 for a null text, one without a letter, or where no language could be learnt.  The
    score is the winner's share when each language weighs exp(-sharpness * entropy / least entropy); ties
    go to the name that sorts first.  A row with a null id is not held out.  Repeated rows are judged each on its own.
    Learnt from at most ``sample`` whole documents per language that fit into its share of ``SAMPLE_BYTES`` (a language of longer texts alone isn't learnt); label, and any other column, is never an input of a
    prediction.
    """
    model = _model(documents if learn_from is None else learn_from, doc_id, text, label, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, names, score, share in _judged(model.value, tk.column(batch.column(2)), sharpness):
                n = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(names, pa.string()), pa.array(score), pa.array(share)], names=["doc_id", "held_out", "lang_pred", "score", "entropy"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double, entropy double")


def drop_unidentified(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The documents, with all their columns, whose language could be told (not ``und``); whole rows pass through, so
    each goes by its own text, whatever its id."""
    model = _model(documents, doc_id, text, label, SAMPLE_DOCS)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [name != "und" for _, _, names, _, _ in _judged(model.value, tk.column(batch.column(0)), SHARPNESS) for name in names]
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(told, pa.bool_()))

    return documents.select(F.col(text).cast("string").alias("_text"), "*").mapInArrow(known, documents.schema)
