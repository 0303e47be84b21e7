"""Vectorised text kernels on Arrow string columns.

Every kernel works on the UTF-8 bytes of whole texts.  A word is a maximal run of
"word bytes"; a 256-entry table says which bytes these are and to which random 64-bit
number each byte is mapped (so A-Z can be folded to a-z while hashing).  A word's hash is the sum of a
non-linear function of each byte's number and its place in the word, so words of a regular make-up don't
collide as they do in polynomials; prefix sums give it for a megabyte of text at once.

Texts are handled in groups of at most ``GROUP_BYTES``; a longer text is a group of its own and
is cut at separators into pieces, so working memory is bounded by the longest word and the
number of words of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
_U = np.uint64
_PLACE = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xBF58476D1CE4E5B9)
#: Multipliers of two independent hashes.
_FACTORS = (_U(0xD6E8FEB86659FD93), _U(0xA24BAED4963EE407))


def _random_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, 256, dtype=np.uint64) | _U(1)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make up words, and the 64-bit number of each byte."""

    is_word: np.ndarray
    number: np.ndarray


def _alphabet(separators: np.ndarray, fold: bool) -> Alphabet:
    is_word = np.ones(256, dtype=bool)
    is_word[separators] = False
    number = _random_table(7)
    if fold:
        number[65:91] = number[97:123]
    return Alphabet(is_word, number)


_SPACES = np.array([0x20, *range(0x09, 0x0E)])
#: Words between the six ASCII white-space characters, unchanged and with A-Z folded.
SPACED = _alphabet(_SPACES, fold=False)
SPACED_FOLDED = _alphabet(_SPACES, fold=True)
#: Words of ASCII letters, digits and everything beyond ASCII, with A-Z folded.
ALNUM_FOLDED = _alphabet(np.array([b for b in range(0x80) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]), fold=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits of its input."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


@dataclass
class Column:
    """The bytes of a string column: text i is ``data[offsets[i]:offsets[i + 1]]`` (null: empty)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def column(array: pa.Array) -> Column:
    """Views an Arrow string or binary array; nulls become empty texts."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        kind = np.int32
    elif pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        array, kind = array.cast(pa.large_string()), np.int64
    n = len(array)
    if n == 0:
        return Column(np.empty(0, np.uint8), np.zeros(1, np.int64))
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Column(raw[offs[0] : offs[-1]], offs - offs[0])


@dataclass
class Words:
    """The words of texts ``lo`` to ``hi``: word w has hash ``h[w]`` and bytes ``data[start[w]:end[w]]``
    of the column; text lo + d has the words ``first[d]:first[d + 1]``.  ``h2`` is a second, independent
    hash where it was asked for, else empty."""

    lo: int
    hi: int
    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    h2: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def placed(number: np.ndarray, place: np.ndarray, which: int = 0) -> np.ndarray:
    """What a byte of this number adds to the hash at this place (a multiple of ``_PLACE``) of its word."""
    x = number + place
    x ^= x >> _U(32)
    x *= _FACTORS[which]
    x ^= x >> _U(29)
    return x


def _scan(data: np.ndarray, borders: np.ndarray, alphabet: Alphabet, second: bool) -> tuple[np.ndarray, ...]:
    """Hash, second hash, start and end of all words; no word crosses a border."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = alphabet.is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    b = borders[borders < n]
    begins[b] = inside[b]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    b = b[b > 0] - 1
    ends[b] = inside[b]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    place = np.ones(n, np.int64)
    if len(s):
        place[s] = 1 - np.diff(s, prepend=0)
        place[s[0]] = 1 - s[0]
    place = np.cumsum(place, out=place).view(np.uint64)
    place *= _PLACE
    number, out = alphabet.number[data], []
    for which in range(1 + second):
        term = placed(number, place, which)
        first = term[s]
        np.cumsum(term, out=term)
        out.append(mix(term[e] - term[s] + first))
    return out[0], out[1] if second else np.empty(0, np.uint64), s, e + 1


def _pieces(data: np.ndarray, alphabet: Alphabet) -> Iterator[tuple[int, int]]:
    """Cuts one long text after separators."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + GROUP_BYTES)
        while to < n:
            cut = np.flatnonzero(~alphabet.is_word[data[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
                break
            to = min(n, to + GROUP_BYTES)
        yield at, to
        at = to


def groups(col: Column, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    lo, n = 0, len(col)
    while lo < n:
        hi = int(np.searchsorted(col.offsets, col.offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(col: Column, alphabet: Alphabet, limit: int = GROUP_BYTES, *, second: bool = False) -> Iterator[Words]:
    """The words of all texts, a group of texts at a time."""
    for lo, hi in groups(col, limit):
        base, top = col.offsets[lo], col.offsets[hi]
        data = col.data[base:top]
        if len(data) <= 2 * max(limit, GROUP_BYTES):
            h, h2, s, e = _scan(data, col.offsets[lo:hi] - base, alphabet, second)
        else:
            parts = [[x, x2, y + a, z + a] for a, b in _pieces(data, alphabet) for x, x2, y, z in [_scan(data[a:b], np.zeros(1, np.int64), alphabet, second)]]
            h, h2, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield Words(lo, hi, h, s + base, e + base, np.searchsorted(s, col.offsets[lo : hi + 1] - base), h2)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring stretches from the hashes of both; not linear, and the order counts."""
    out = left * _MIX
    out ^= out >> _U(32)
    out += right
    out *= _FACTORS[0]
    out ^= out >> _U(29)
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries (those at the end, without k entries, are left out), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, size = None, 0, h, 1
    while True:
        if k & size:
            out = power if out is None else joined(out[: len(h) - have - size + 1], power[have:])
            have += size
        if have == k:
            return mix(out[:n] + _U(k))
        power, size = joined(power[:-size], power[size:]), 2 * size


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Where a window of k words lies within one text: the positions of all such windows."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    total = int(counts.sum())
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift


def spread(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) by text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def covered(n: int, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in one of the intervals [at, at + length)."""
    delta = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(delta[:n]) > 0


def hash_words(texts: list[str], alphabet: Alphabet) -> list[np.ndarray]:
    """Word hashes of a few texts."""
    col = column(pa.array(texts, pa.string()))
    out: list[np.ndarray] = []
    for w in words(col, alphabet):
        out += [w.h[w.first[d] : w.first[d + 1]] for d in range(w.hi - w.lo)]
    return out
