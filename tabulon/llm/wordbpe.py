"""Ids of a lower-casing word BPE, computed for many distinct words at once.

White space never takes part in a token of such a tokenizer, so a text's ids are the ids of its
white-space separated chunks, one after the other, and each distinct chunk is encoded once.  Chunks of
printable ASCII and Latin-1 letters are encoded here with numpy: all pieces of one length form a matrix in
which each round applies every row's best merge.  Any other chunk (apostrophes, special tokens, other
scripts, very long words) goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from . import textkernel as tk

_NONE = np.int32(2**31 - 1)
_LONGEST = 96
#: Distinct chunks remembered by one worker.
REMEMBERED = 600_000


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class _Merges:
    """Rank and result of each pair of ids, in an open-addressing table."""

    BITS = 19

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.ranks = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, _NONE, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        slot = self._slot(key)
        at = self.keys[slot]
        out = np.where(at == key, self.ranks[slot], _NONE)
        todo = np.nonzero((at != key) & (at != -1))
        while len(todo[0]):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            at = self.keys[slot[todo]]
            same = at == key[todo]
            out[tuple(x[same] for x in todo)] = self.ranks[slot[tuple(x[same] for x in todo)]]
            todo = tuple(x[~same & (at != -1)] for x in todo)
        return out


class WordBpe:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, chars = model["vocab"], _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + model["end_of_word_suffix"]] for c in chars], np.int32)
        self.merges = _Merges(vocab, model["merges"])
        self.kind = np.zeros(256, np.uint8)
        self.kind[0x21:0x7F] = 3
        self.kind[0x30:0x3A] = 2
        self.kind[0x41:0x5B] = self.kind[0x61:0x7B] = 1
        self.kind[[0x27, 0x3C]] = 0
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] += 32
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _merge(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Final ids of pieces that have equally many bytes: (row numbers, matrix of their ids) by count."""
        rows, out = np.arange(len(ids)), []
        rank = self.merges.rank(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else None
        while ids.shape[1] > 1:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(ids)), at]
            over = best == _NONE
            if over.any():
                out.append((rows[over], ids[over]))
                go = ~over
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    return out
            line, width = np.arange(len(ids)), ids.shape[1] - 1
            ids = np.where(np.arange(width) <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[line, at] = self.merges.result[best]
            if width > 1:
                rank = np.where(np.arange(width - 1) < at[:, None], rank[:, :-1], rank[:, 1:])
                left = at > 0
                rank[line[left], at[left] - 1] = self.merges.rank(ids[line[left], at[left] - 1], ids[line[left], at[left]])
                right = at < width - 1
                rank[line[right], at[right]] = self.merges.rank(ids[line[right], at[right]], ids[line[right], at[right] + 1])
        out.append((rows, ids))
        return out

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some chunks, one after the other, and how many each has."""
        size = end - start
        first = np.cumsum(size) - size
        raw = data[np.repeat(start - first, size) + np.arange(int(size.sum()))]
        kind = self.kind[raw]
        after = np.zeros(len(raw), bool)
        after[1:] = raw[:-1] == 0xC3
        after[first] = False
        latin = after & (raw >= 0x80) & (raw < 0xC0) & (raw != 0x97) & (raw != 0xB7)
        kind[latin | (raw == 0xC3)] = 1
        buf = self.lower[raw]
        buf[latin & (raw < 0x9F)] += 32
        head = np.ones(len(raw), bool)
        head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        head[first] = True
        piece = np.flatnonzero(head)
        length = np.diff(np.append(piece, len(raw)))
        owner = np.repeat(np.arange(len(size)), size)[piece]
        foreign = np.add.reduceat((kind == 0).astype(np.int64), first) > 0
        foreign[owner[length > _LONGEST]] = True
        own = ~foreign[owner]
        counts = np.zeros(len(piece), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(length[own]).tolist():
            rows = np.flatnonzero(own & (length == n))
            block = buf[piece[rows][:, None] + np.arange(n)]
            ids = self.inner[block]
            ids[:, -1] = self.last[block[:, -1]]
            for line, found in self._merge(ids):
                counts[rows[line]] = found.shape[1]
                parts.append((rows[line], found))
        rest = np.flatnonzero(foreign)
        texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        known = [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)] if texts else []
        lead = np.searchsorted(owner, rest)
        counts[lead] = [len(x) for x in known]
        where = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for rows, found in parts:
            flat[where[rows][:, None] + np.arange(found.shape[1])] = found
        for i, ids in zip(lead.tolist(), known, strict=True):
            flat[where[i] : where[i] + len(ids)] = ids
        return flat, np.bincount(owner, counts, len(size)).astype(np.int64)

    def ids(self, col: tk.Column, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a group of texts, one after the other, and how many each text has."""
        if not len(w.h):
            return np.empty(0, np.uint32), np.zeros(w.hi - w.lo, np.int64)
        seen, example, which = np.unique(w.h, return_index=True, return_inverse=True)
        if len(self.hash) + len(seen) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.hash, seen)
        new = np.ones(len(seen), bool)
        inside = at < len(self.hash)
        new[inside] = self.hash[at[inside]] != seen[inside]
        if new.any():
            flat, counts = self._encode(col.data, w.start[example[new]], w.end[example[new]])
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[self.used : self.used + len(flat)] = flat
            where = self.used + np.cumsum(counts) - counts
            self.used += len(flat)
            self.hash, self.at, self.count = np.insert(self.hash, at[new], seen[new]), np.insert(self.at, at[new], where), np.insert(self.count, at[new], counts)
            at = np.searchsorted(self.hash, seen)
        begin, count = self.at[at][which], self.count[at][which]
        to = np.cumsum(count)
        out = self.flat[np.repeat(begin - (to - count), count) + np.arange(int(to[-1]))]
        return out, tk.spread(w.first, count)


@cache
def load(path: str) -> WordBpe:
    return WordBpe(path)
