"""Language-model scores: online logistic context mixing of bits, and a smoothed unigram base.

A text (A-Z folded) is a sequence of units: the words, each followed by a terminator, and the gaps between them,
each of which knows the byte before it.  The bytes of a unit are predicted bit by bit along a fixed binary code.
For each bit, several contexts predict: the last two, three and five bytes of the unit and, as word
context, all of the unit so far.  The counts of zeros and ones that followed a context give a logit each; the logits
are summed with weights that a gate selects (how often the word context and the context of five bytes were seen),
and the sum is refined by an adaptive table of (gate, quantised logit).  Within a document a cache of its
own words is mixed in, whose share adapts online from the same start for every document.  A text's score is the
log10 of the product of all predictions; bits per byte follow from it.

What the model knows grows with the corpus, and nothing is sampled.  Documents are dealt into blocks of about
``BLOCK_BYTES``.  A block sends the counts of its distinct contexts to cells (ranges of the context's hash), which
sum them over all training documents and return to each block the counts of the contexts that it
holds: neither the driver nor any task ever has all of them.  Weights and refinement are learnt online in every block, on
all of its training documents, and averaged over the blocks in the same way.  A bit of a training document is
predicted without its own occurrence.

The base needs the count of each word over all training documents, which is that of its terminator.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: Bytes of text whose contexts are gathered and looked up together.
BLOCK_BYTES = 8 << 20
#: Bytes whose words are looked for at a time, so that what this needs stays in the processor's caches.
SCAN_BYTES = 1 << 17
#: Bytes of context of the predictors beside the word context.
ORDERS = (2, 3, 5)
#: Bytes that UTF-8 never has: the end of a word, of a gap and of the text, the head of a gap, and the start of the text.
WORD_END, GAP_END, TEXT_END, GAP, START = 0xF8, 0xF9, 0xFA, 0xFB, 0xFC
#: Levels of confidence (powers of two) in the word context and (powers of four) in the longest other one; each pair is a gate.
LEVELS, COARSE = 16, 4
GATES = LEVELS * COARSE
#: Levels of the refinement, and the logits they span.
CELLS, SPREAD = 32, 10.0
#: Bits of a step of learning, and how firmly weights hold to their start.
STEP, HOLD = 8192, 20.0
FIRST = 0.3
#: Added to counts of zeros and ones.
PRIOR = 0.15
#: The document caches: tokens between two updates, their rate, and the logits of their shares at the start.
CHUNK, CACHE_RATE, CACHE_START = 32, 0.15, (-3.0, -3.0)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_U = np.uint64
_PLACE, _SALT = _U(0x9E3779B97F4A7C15), _U(0xE7037ED1A0B428DB)


def _assumed() -> np.ndarray:
    """Rough shares of bytes, which shape the code; what is really coded decides on costs, not on right or wrong."""
    w = np.full(256, 0.02)
    w[0x80:0xC0], w[0xC2:0xE0], w[0xE0:0xF0] = 0.3, 0.2, 0.1
    w[0x21:0x40], w[0x30:0x3A] = 0.1, 0.4
    w[[0x2C, 0x2E]] = 1.0
    for rank, c in enumerate(b"etaoinshrdlucmfwypvbgkjqxz"):
        w[c] = 10.0 / (1 + 0.25 * rank)
    w[[0x20, 0x0A, TEXT_END]] = 15.0, 1.0, 0.5
    w[[WORD_END, GAP_END]] = 16.0, 16.0
    return w


class Code:
    """A binary code of all bytes.  Bytes are called by their rank among the leaves; ``middle[d][r]`` is the first leaf of the
    right branch at depth d on the way to leaf r, ``left[d][r]`` whether r lies before it, ``length[r]`` the depth of the leaf
    and ``ends`` all of these depths."""

    def __init__(self, weights: np.ndarray) -> None:
        heap = [(float(w), i, [i]) for i, w in enumerate(weights)]
        depth, cuts = {}, []
        heapq.heapify(heap)
        fresh, tree = 256, {}
        while len(heap) > 1:
            (a, x, left), (b, y, right) = heapq.heappop(heap), heapq.heappop(heap)
            tree[fresh] = (x, y, len(left), len(right))
            heapq.heappush(heap, (a + b, fresh, left + right))
            fresh += 1
        leaves = heap[0][2]
        self.rank = np.empty(256, np.uint8)
        self.rank[leaves] = np.arange(256)
        stack = [(heap[0][1], 0, 0)]
        while stack:
            node, begin, d = stack.pop()
            if node < 256:
                depth[begin] = d
                continue
            x, y, n, m = tree[node]
            cuts.append((d, begin, begin + n + m, begin + n))
            stack += [(x, begin, d + 1), (y, begin + n, d + 1)]
        self.length = np.array([depth[r] for r in range(256)])
        self.middle = np.zeros((int(self.length.max()), 256), np.int64)
        for d, begin, end, middle in cuts:
            self.middle[d, begin:end] = middle
        self.left, self.ends = np.arange(256) < self.middle, set(self.length.tolist())


CODE = Code(_assumed())
_END = int(CODE.rank[WORD_END])


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all stretches, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _ranked(h: np.ndarray, low: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries in the order of their values, and the values in that order.  Sorting is far cheaper than
    sorting places, so the upper bits of a value (and its ``low`` lowest ones) are sorted with its place as one number; the
    few stretches that this leaves undecided are sorted afterwards."""
    bits = int(len(h)).bit_length()
    wide = max(int(h.max(initial=0)).bit_length(), 1)
    upper = h << _U(64 - wide) >> _U(bits + low) << _U(bits + low)
    if low:
        upper |= (h & _U((1 << low) - 1)) << _U(bits)
    order = np.sort(upper | np.arange(len(h), dtype=np.uint64))
    if not low and wide + bits <= 64:
        return (order & _U((1 << bits) - 1)).view(np.int64), order >> _U(bits) << _U(bits) >> _U(64 - wide)
    group = order >> _U(bits + low)
    order &= _U((1 << bits) - 1)
    order = order.view(np.int64)
    s = h[order]
    if wide + bits > 64:
        upper = s >> _U(low)
        mixed = group[1:][(group[1:] == group[:-1]) & (upper[1:] != upper[:-1])]
        if len(mixed):
            mixed = np.unique(mixed)
            begin = np.searchsorted(group, mixed)
            wrong = _flat(begin, np.searchsorted(group, mixed, "right") - begin)
            order[wrong] = order[wrong[np.lexsort((wrong, s[wrong]))]]
            s[wrong] = h[order[wrong]]
    return order, s


def _named(h: np.ndarray, low: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, sorted, an occurrence of each, and which value each entry has."""
    order, s = _ranked(h.view(np.uint64), low)
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(head) - 1
    return s[head], order[head], which


class Block:
    """The texts of a block as units, and the distinct (context, byte) pairs of these.

    ``token`` and ``gap`` say which unit each word and gap is; unit u has the ``steps[unit[u]:unit[u + 1]]``, which are
    rows of the table of edges: (word context, byte).  For each predictor k, ``contexts[k]`` are its distinct contexts, sorted,
    ``pairs[k]`` the distinct (place of the context * 256 + byte's rank), ``count[k]`` their occurrences in training
    documents, and ``pair_of[k]`` the pair of each edge.
    """

    def __init__(self, col: tk.Column, held: np.ndarray) -> None:
        found = list(tk.words(col, tk.SPACED_FOLDED, SCAN_BYTES))
        h, start, end, doc = (np.concatenate(x) if found else np.empty(0, t) for x, t in (([w.h for w in found], np.uint64), ([w.start for w in found], int), ([w.end for w in found], int), ([w.doc + w.lo for w in found], int)))
        del found
        n, data = len(held), col.data
        self.doc, self.size = doc.astype(np.int32), np.bincount(doc, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        # Gap i + d comes before word i of all, in text d; text d's last one ends the text.
        before, last = np.arange(len(h)) + doc, self.first[1:] + np.arange(n)
        begin, stop = np.empty(len(h) + n, int), np.empty(len(h) + n, int)
        begin[self.first[:-1] + np.arange(n)], begin[before + 1] = col.offsets[:-1], end
        stop[before], stop[last] = start, col.offsets[1:]
        self.gap_doc = np.repeat(np.arange(n, dtype=np.int32), self.size + 1)
        ends = np.zeros(len(begin), bool)
        ends[last] = True
        prior = np.full(len(begin), START, np.uint8)
        prior[before + 1] = _FOLD[data[end - 1]]
        size = stop - begin
        # A gap of one byte or none is named by this, what came before, and whether it ends the text.
        short = np.where(size > 0, data[np.minimum(begin, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.int64)
        key = short | prior.astype(np.int64) << 8 | ends.astype(np.int64) << 16 | (size > 0).astype(np.int64) << 17
        long = np.flatnonzero(size > 1)
        if len(long):
            at = _flat(begin[long], size[long])
            place = _flat(np.ones(len(long), int), size[long]).astype(np.uint64) * _PLACE
            whole = np.add.reduceat(tk.placed(tk.SPACED.number[data[at]], place), np.concatenate([[0], np.cumsum(size[long])[:-1]]))
            _, _, named = _named(tk.mix(whole + key[long].astype(np.uint64) * _SALT))
            key[long] = named + (1 << 18)
        used = np.flatnonzero(np.bincount(key))
        name = np.zeros(int(used[-1]) + 1 if len(used) else 0, int)
        name[used] = np.arange(len(used))
        self.gap, gap = name[key], np.empty(len(used), int)
        gap[self.gap] = np.arange(len(key))
        self.gap = self.gap.astype(np.int32)
        _, word, self.token = _named(h)
        self.token = self.token.astype(np.int32)
        del h, key, short, before
        self.n_words = len(word)
        self.gap = self.gap + len(word)
        units = len(word) + len(gap)
        unseen = np.bincount(self.token[held[self.doc]], minlength=units) + np.bincount(self.gap[held[self.gap_doc]], minlength=units)
        weight = np.bincount(self.token, minlength=units) + np.bincount(self.gap, minlength=units) - unseen
        # The bytes of the units: words with their end, gaps with a head that says what came before.
        inner = np.concatenate([end[word] - start[word], size[gap]])
        head = np.concatenate([np.zeros(len(word), int), np.full(len(gap), 2)])
        self.unit = np.concatenate([[0], np.cumsum(head + inner + 1)])
        raw = np.empty(int(self.unit[-1]), np.uint8)
        raw[_flat(self.unit[:-1] + head, inner)] = _FOLD[data[_flat(np.concatenate([start[word], begin[gap]]), inner)]]
        raw[self.unit[1 : len(word) + 1] - 1] = WORD_END
        raw[self.unit[len(word) + 1 :] - 1] = np.where(ends[gap], TEXT_END, GAP_END)
        raw[self.unit[len(word) : -1]], raw[self.unit[len(word) : -1] + 1] = GAP, prior[gap]
        del start, end, begin, stop, size, ends, prior, doc
        whole_size = np.diff(self.unit)
        owner = np.repeat(np.arange(len(inner)), whole_size)
        rel = np.arange(len(raw)) - np.repeat(self.unit[:-1], whole_size)
        coded = np.ones(len(raw), bool)
        coded[self.unit[len(word) : -1]] = coded[self.unit[len(word) : -1] + 1] = False
        term = tk.placed(tk.SPACED.number[raw], (rel + 1).astype(np.uint64) * _PLACE)
        so_far = np.cumsum(term) - term
        whole = tk.mix(so_far - np.repeat(so_far[self.unit[:-1]], whole_size))
        del term, so_far
        rank = CODE.rank[raw]
        key, edge, which = _named(whole[coded] & ~_U(255) | rank[coded], 8)
        edge = np.flatnonzero(coded)[edge]
        self.steps = np.full(len(raw), len(edge), np.int32)
        self.steps[coded] = which
        self.rank = rank[edge].astype(np.int64)
        owner = owner[coded]
        some = np.flatnonzero((unseen > 0)[owner])
        self.weight = np.bincount(which, weight.astype(float)[owner], len(edge)).astype(np.int64)
        self.held = np.bincount(which[some], unseen[owner[some]], len(edge)).astype(np.int64)
        del whole, which, owner, coded
        context = key >> _U(8)
        head = np.ones(len(key), bool)
        head[1:] = context[1:] != context[:-1]
        self.contexts, self.pairs, self.count, self.pair_of = [context[head] << _U(8)], [(np.cumsum(head) - 1) * 256 + self.rank], [self.weight], [slice(None)]
        # Shorter contexts are the bytes themselves, nine bits each, not a hash; each follows from the next longer one.
        packed, known = np.zeros(len(edge), np.uint64), rel[edge]
        # The eight bytes before each place, read as one number.
        behind = np.ndarray(len(raw), "<u8", np.concatenate([np.zeros(8, np.uint8), raw]), strides=(1,))[edge]
        for k in range(1, max(ORDERS) + 1):
            packed |= ((behind >> _U(64 - 8 * k) & _U(255)) + _U(1)) * (known >= k) << _U(9 * (k - 1))
        last, count, found = packed << _U(8) | self.rank.astype(np.uint64), self.weight, []
        pair_of = None
        for k in sorted(ORDERS, reverse=True):
            last, _, which = _named(last & _U((1 << (9 * k + 8)) - 1))
            count = np.bincount(which, count, len(last)).astype(np.int64)
            pair_of = which if pair_of is None else which[pair_of]
            # Contexts are spread over the cells by a hash that is one to one.
            spread = tk.mix(last >> _U(8) | _U(k << 58))
            contexts, _, where = _named(spread)
            pairs = where * 256 + (last & _U(255)).astype(np.int64)
            order = np.argsort(pairs)
            to = np.empty(len(order), np.int64)
            to[order] = np.arange(len(order))
            found.append((contexts, pairs[order], count[order], to[pair_of]))
        for contexts, pairs, n, of in reversed(found):
            self.contexts.append(contexts)
            self.pairs.append(pairs)
            self.count.append(n)
            self.pair_of.append(of)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(context, byte) pairs with their counts, as far as this block knows."""
        return list(zip(self.pairs, self.count, strict=True))

    def bits(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, ...]]]]:
        """Level by level of the code, for what it hasn't ended yet: edges, and for each predictor its pairs' counts of zeros
        and ones, their bits, and where the edges' own are.  The word context has a pair for each edge, so its arrays are those of
        the edges."""
        walks = [_walk(pairs, len(contexts), *table) for contexts, pairs, table in zip(self.contexts, self.pairs, tables, strict=True)]
        at, where, sizes = np.arange(len(self.rank)), list(self.pair_of), [len(x) for x in self.pairs]
        for found in zip(*walks, strict=True):
            keep = found[0][0]
            if keep is not None:
                at = at[keep]
                for k, of in enumerate(where[1:], 1):
                    now = np.empty(sizes[k], np.int32)
                    now[found[k][0]] = np.arange(len(found[k][0]), dtype=np.int32)
                    where[k], sizes[k] = now[of[keep]], len(found[k][0])
            if not len(at):
                return
            yield at, [(*own[1:], of) for own, of in zip(found, where, strict=True)]


def _level(n: np.ndarray) -> np.ndarray:
    """The whole part of log2(n + 1), read off the exponents."""
    return ((n + 1).view(np.int32) >> 23) - 127


def _inputs(found: list[tuple[np.ndarray, ...]], some: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Gates and logits of some edges; ``own`` occurrences of the bit itself are left out of the counts."""
    logits, gate = np.empty((len(found), len(some)), np.float32), np.zeros(len(some), np.uint8)
    for k, (zeros, ones, bit, of) in enumerate(found):
        if k == 0:
            zeros, ones, bit, where = zeros[some], ones[some], bit[some], slice(None)
        else:
            where = of[some]
        if own:
            zeros, ones = np.maximum(zeros - ~bit, 0), np.maximum(ones - bit, 0)
        logits[k] = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))[where]
        if k == 0:
            gate += (np.minimum(_level(zeros + ones), LEVELS - 1) * COARSE).astype(np.uint8)
        elif k == len(found) - 1:
            gate += np.minimum((_level(zeros + ones) + 1) // 2, COARSE - 1).astype(np.uint8)[where]
    return gate, logits


def _walk(pairs: np.ndarray, contexts: int, key: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair (context * 256 + byte's rank) whose code hasn't ended, level by level of the code: how often the
    context was followed by the left and the right branch, and whether this byte is in the right one; and before these, which
    pairs of the level before are still there (None: all)."""
    total = np.concatenate([[0], np.cumsum(count)])
    first = np.concatenate([[0], np.cumsum(np.bincount(key >> 8, minlength=contexts))])
    follow, before = (key & 255).astype(np.uint8).tobytes(), np.zeros(len(key) + 1, np.int32)
    rank = pairs & 255
    low, high = first[pairs >> 8], first[(pairs >> 8) + 1]
    below, above = total[low], total[high]
    for d, left in enumerate(CODE.left):
        keep = None
        if d in CODE.ends:
            keep = np.flatnonzero(CODE.length[rank] > d)
            pairs, rank, low, high, below, above = (x[keep] for x in (pairs, rank, low, high, below, above))
        bit = ~left[rank]
        if len(rank) * 16 > len(key):
            # A branch's bytes lie together: those of its left side, counted over the whole table, say where the right one begins.
            np.cumsum(np.frombuffer(follow.translate(left.tobytes()), np.uint8), dtype=np.int32, out=before[1:])
            cut = low + (before[high] - before[low])
        else:
            # Few are left; most of these have one successor or none, which lies on one side or the other.
            cut = low.copy()
            one, more = np.flatnonzero(high - low == 1), np.flatnonzero(high - low > 1)
            cut[one] += left[key[low[one]] & 255]
            cut[more] = np.searchsorted(key, (pairs[more] & ~np.int64(255)) + CODE.middle[d][rank[more]])
        inner = total[cut]
        yield keep, (inner - below).astype(np.float32), (above - inner).astype(np.float32), bit
        low, high = np.where(bit, cut, low), np.where(bit, high, cut)
        below, above = np.where(bit, inner, below), np.where(bit, above, inner)


def _cell(total: np.ndarray) -> np.ndarray:
    return np.clip((total + SPREAD) * (CELLS / (2 * SPREAD)), 0, CELLS - 1).astype(np.int64)


#: Per gate: the sum of weights times bits, the bits, and ones and bits of the refinement's cells.
FIT = len(ORDERS) + 2 + 2 * CELLS


def learn(block: Block) -> np.ndarray:
    """Online learning of weights and refinement on a block's training documents, as sums (see ``FIT``).  Edges come in the
    order of a hash; each step takes the next ones of every level of the code."""
    levels, k = [], len(ORDERS) + 1
    for at, found in block.bits(block.tables()):
        some = np.flatnonzero(block.weight[at])
        levels.append((*_inputs(found, some, 1), found[0][2][some], block.weight[at][some].astype(np.int32)))
    out, weight = np.zeros((GATES, FIT), np.int64), np.full((GATES, k), FIRST)
    bend = np.tile(HOLD * np.eye(k), (GATES, 1, 1))
    n_steps = max(1, sum(len(x[2]) for x in levels) // STEP)
    cuts = [np.linspace(0, len(x[2]), n_steps + 1).astype(int).tolist() for x in levels]
    for step in range(n_steps if levels else 0):
        rows = [tuple(x[..., own[step] : own[step + 1]] for x in level) for level, own in zip(levels, cuts, strict=True)]
        gate, x, bit, n = (np.concatenate(p, axis=-1, dtype=t) for p, t in zip(zip(*rows, strict=True), (np.intp, float, bool, float), strict=True))
        p = 1 / (1 + np.exp(-np.clip(_mixed(weight, gate, x), -12, 12)))
        error, firm = n * (bit - p), n * p * (1 - p)
        slope = np.stack([np.bincount(gate, error * x[j], GATES) for j in range(k)], axis=1)
        for i in range(k):
            part = firm * x[i]
            for j in range(i, k):
                bend[:, i, j] = bend[:, j, i] = bend[:, i, j] + np.bincount(gate, part * x[j], GATES)
        # An online Newton step: what was learnt so far counts by how much was seen.
        weight += np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
    for level in levels:
        for a in range(0, len(level[2]), STEP):
            gate, x, bit, n = (x[..., a : a + STEP].astype(t) for x, t in zip(level, (np.intp, float, bool, float), strict=True))
            cell = gate * CELLS + _cell(_mixed(weight, gate, x))
            out[:, -2 * CELLS : -CELLS] += np.bincount(cell, n * bit, GATES * CELLS).reshape(GATES, CELLS).astype(np.int64)
            out[:, -CELLS:] += np.bincount(cell, n, GATES * CELLS).reshape(GATES, CELLS).astype(np.int64)
    out[:, k] = out[:, -CELLS:].sum(axis=1)
    out[:, :k] = np.rint(weight * out[:, k, None] * 1024.0)
    return out


def _mixed(weight: np.ndarray, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sum of logits x, weighted as the gates say."""
    out = weight[:, 0][gate] * x[0]
    for j in range(1, len(x)):
        out += weight[:, j][gate] * x[j]
    return out


class Mixer:
    """Gated weights and refinement, averaged over what the blocks learnt."""

    def __init__(self, fit: np.ndarray) -> None:
        k = len(ORDERS) + 1
        seen = fit[:, k]
        self.weight = np.where(seen[:, None] > 0, fit[:, :k] / 1024 / np.maximum(seen, 1)[:, None], FIRST).astype(np.float32)
        ones, n = fit[:, -2 * CELLS : -CELLS], fit[:, -CELLS:]
        centre = 1 / (1 + np.exp(-((np.arange(CELLS) + 0.5) / CELLS * 2 * SPREAD - SPREAD)))
        self.refined = ((ones + 32 * centre) / (n + 32)).astype(np.float32).ravel()

    def edges(self, block: Block, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """log2 of the probability of each edge's byte, and a zero for bytes that aren't coded: as held-out and as training
        documents have it."""
        out, uses = np.zeros((2, len(block.rank) + 1)), (block.held > 0, block.weight > 0)
        for at, found in block.bits(tables):
            for own, used in enumerate(uses):
                some = np.flatnonzero(used[at])
                gate, logits = _inputs(found, some, own)
                gate = gate.astype(np.intp)
                total = _mixed(self.weight, gate, logits)
                p = (1 / (1 + np.exp(-np.clip(total, -12, 12))) + self.refined[gate * CELLS + _cell(total)]) / 2
                p = np.clip(p, np.float32(2**-14), np.float32(1 - 2**-14))
                out[own][at[some]] += np.log2(np.where(found[0][2][some], p, 1 - p))
        return out

    def texts(self, block: Block, tables: list[tuple[np.ndarray, np.ndarray]], held: np.ndarray) -> np.ndarray:
        """log2 of the probability of each text."""
        steps, begin = block.steps.astype(np.intp), block.unit[:-1]
        by_unit = [np.add.reduceat(x[steps], begin) if len(steps) else np.zeros(0) for x in self.edges(block, tables)]
        gap, word = (np.where(held[doc], by_unit[0][unit], by_unit[1][unit]) for doc, unit in ((block.gap_doc, block.gap), (block.doc, block.token)))
        return np.bincount(block.gap_doc, gap, len(held)) + cached(word, block.token, block.doc, block.first)


def _times_before(key: np.ndarray) -> np.ndarray:
    """How often each entry's key occurred before it."""
    order, s = _ranked(key.view(np.uint64))
    same = np.zeros(len(key), bool)
    same[1:] = s[1:] == s[:-1]
    run = np.arange(len(key), dtype=np.int32)
    out = np.empty(len(key), np.int32)
    out[order] = run - np.maximum.accumulate(np.where(same, 0, run))
    return out


def cached(model: np.ndarray, token: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log2 of the probability of each text's words, when two caches of the document's own words are mixed in: of all words so
    far, and of those that followed the same word.  All documents of the block go on in step, ``CHUNK`` words at a time;
    the caches' shares start at the same values in each, and adapt online."""
    token, doc = token.astype(np.int64), doc.astype(np.int64)
    n = int(token.max(initial=0)) + 2
    before = np.zeros(len(token), np.int64)
    before[1:] = token[:-1] + 1
    before[first[:-1][first[:-1] < first[1:]]] = 0
    _, _, pair = _named((before * n + token).view(np.uint64))
    place = np.arange(len(token)) - first[doc]
    behind = _times_before(doc * n + before)
    with np.errstate(invalid="ignore", divide="ignore"):
        caches = [np.where(place > 0, _times_before(doc * n + token) / place, -1.0), np.where(behind > 0, _times_before(doc * (int(pair.max(initial=0)) + 1) + pair) / behind, -1.0)]
    size = np.diff(first)
    longest = np.argsort(-size, kind="stable")
    state, out = np.tile(np.array(CACHE_START)[:, None], (1, len(size))), np.zeros(len(size))
    for a in range(0, int(size.max(initial=0)), CHUNK):
        rows = longest[: int(np.searchsorted(-size[longest], -a, "left"))]
        at = first[rows][:, None] + a + np.arange(CHUNK)
        real = at < first[rows + 1][:, None]
        at = np.minimum(at, len(token) - 1)
        here, cost = [c[at] for c in caches], model[at]
        odds = [np.where(c >= 0, np.exp(s)[:, None], 0.0) for c, s in zip(here, state[:, rows], strict=True)]
        rest = 1 / (1 + odds[0] + odds[1])
        own = [o * rest * np.maximum(c, 0) for o, c in zip(odds, here, strict=True)]
        found = own[0] + own[1]
        total = found + rest * np.exp2(cost)
        # The product of a very long word's bits stays in the log.
        out[rows] += np.where(real, np.where(found > 0, np.log2(np.maximum(total, 1e-300)), np.log2(rest) + cost), 0).sum(axis=1)
        for k in range(2):
            # Bayes: how far the cache is responsible for what came.
            state[k, rows] += CACHE_RATE * np.where(real, own[k] / np.maximum(total, 1e-300) - odds[k] * rest, 0).sum(axis=1)
    return out


def is_held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 10, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _parsed(t: pa.Table) -> tuple[Block, np.ndarray]:
    held = t.column("held_out").to_numpy().astype(bool)
    return Block(tk.column(t.column("text")), held), held


def _cell_bounds(contexts: np.ndarray, n: int) -> np.ndarray:
    """Contexts are dealt to n cells by ranges of their upper 32 bits: where each cell's begin in a sorted list."""
    cell = (contexts >> _U(32)) * _U(n) >> _U(32)
    return np.searchsorted(cell, np.arange(n + 1).astype(np.uint64))


def _by_cell(bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Where the entries of several lists, each cut into cells by its bounds, go when they are put together cell by cell, and
    where the cells begin then."""
    size = np.diff(bounds, axis=1)
    begin = (np.cumsum(size.T.ravel()) - size.T.ravel()).reshape(size.T.shape).T
    return [_flat(a, n) for a, n in zip(begin, size, strict=True)], np.concatenate([[0], np.cumsum(size.sum(axis=0))])


def _placed(lists: tuple[np.ndarray, ...], at: list[np.ndarray]) -> np.ndarray:
    out = np.empty(sum(map(len, lists)), lists[0].dtype)
    for own, to in zip(lists, at, strict=True):
        out[to] = own
    return out


_CODEC = pa.Codec("zstd", 1)


def _packed(arrays: list[np.ndarray], cuts: list[np.ndarray]) -> list[bytes]:
    """Arrays, each cut into as many parts, as planes of bytes, compressed part by part: counts and the steps between sorted
    contexts have few bytes that aren't zero."""
    planes = [(memoryview(x), k) for k, a in enumerate(arrays) for x in np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)]
    bounds = list(zip(*(c.tolist() for c in cuts), strict=True))
    parts = (b"".join([x[own[k] : to[k]] for x, k in planes]) for own, to in zip(bounds[:-1], bounds[1:], strict=True))
    return [_CODEC.compress(raw, asbytes=True) if raw else b"" for raw in parts]


def _unpacked(parts: list[bytes], sizes: list[list[int]], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The whole arrays again."""
    widths = [np.dtype(k).itemsize for k in kinds]
    planes: list[list[memoryview]] = [[] for _ in range(sum(widths))]
    for data, own in zip(parts, sizes, strict=True):
        whole = sum(n * w for n, w in zip(own, widths, strict=True))
        if not whole:
            continue
        raw, at, i = memoryview(_CODEC.decompress(data, whole, asbytes=True)), 0, 0
        for n, w in zip(own, widths, strict=True):
            for _ in range(w):
                planes[i].append(raw[at : at + n])
                at, i = at + n, i + 1
    out, at = [], 0
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.stack([np.frombuffer(b"".join(x), np.uint8) for x in planes[at : at + w]], axis=1).view(k).ravel())
        at += w
    return out


_SENT = "cell int, block int, sizes binary, data binary, fit binary"
_BACK = "block int, cell int, sizes binary, data binary, fit binary, tokens long, kinds long"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(names)})


def _send(n: int):
    def send(t: pa.Table) -> pa.Table:
        """A row for each cell: the block's contexts there, how many bytes followed each, which, and how often."""
        block, _ = _parsed(t)
        fit = learn(block)
        parts, cuts = [], []
        for contexts, pairs, count in zip(block.contexts, block.pairs, block.count, strict=True):
            some = count > 0
            pairs, count = pairs[some], count[some]
            bounds = _cell_bounds(contexts, n)
            steps = np.diff(contexts, prepend=_U(0))
            begin = bounds[:-1][bounds[:-1] < bounds[1:]]
            steps[begin] = contexts[begin]
            follow = np.bincount(pairs >> 8, minlength=len(contexts)).astype("<u2")
            parts.append((steps, follow, (pairs & 255).astype(np.uint8), count.astype("<i8")))
            cuts.append((bounds, np.searchsorted(pairs, bounds * 256)))
        del block
        number, rows = t.column("block")[0].as_py(), []
        at = [_by_cell(np.stack(c)) for c in zip(*cuts, strict=True)]
        sizes = np.column_stack([*(np.diff(c[0]) for c in cuts), np.diff(at[1][1])]).astype("<i4")
        packed = _packed([_placed(x, at[k > 1][0]) for k, x in enumerate(zip(*parts, strict=True))], [x[1] for x in at for _ in range(2)])
        for c, full in enumerate(sizes.any(axis=1).tolist()):
            if full or c < GATES:
                rows.append((c, number, sizes[c].tobytes(), packed[c], fit[c::n].astype("<i8").tobytes()))
        return _table(rows, _SENT)

    return send


def _add(t: pa.Table) -> pa.Table:
    """Sums a cell's counts, and returns to each block those of its contexts."""
    cell, block = t.column("cell")[0].as_py(), t.column("block").to_pylist()
    sizes = np.frombuffer(b"".join(t.column("sizes").to_pylist()), "<i4").reshape(len(block), -1)
    own = np.column_stack([sizes[:, :-1].sum(axis=1)] * 2 + [sizes[:, -1]] * 2).tolist()
    steps, follow, rank, count = _unpacked(t.column("data").to_pylist(), own, ("<u8", "<u2", "u1", "<i8"))
    sizes = sizes[:, :-1]
    kind = np.tile(np.arange(sizes.shape[1]), len(block))
    first_kind = np.repeat(kind == 0, sizes.ravel())
    # The steps of each row and predictor begin anew; the predictor is part of a context's name.
    contexts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(steps)])
    begin = np.cumsum(sizes.ravel()) - sizes.ravel()
    contexts = tk.mix(contexts[1:] + np.repeat(kind.astype(np.uint64) * _SALT - contexts[begin], sizes.ravel()))
    _, _, which = _named(contexts)
    pairs, _, pair = _named((np.repeat(which, follow) * 256 + rank).view(np.uint64))
    pairs, total = pairs.view(np.int64), np.bincount(pair, count, len(pairs)).astype("<i8")
    first = np.searchsorted(pairs, np.arange(int(which.max(initial=-1)) + 2) * 256)
    fit = np.sum([np.frombuffer(x, "<i8") for x in t.column("fit").to_pylist()], axis=0).astype("<i8").tobytes()
    word = np.zeros(len(first) - 1, bool)
    word[which[first_kind]] = True
    ends = ((pairs & 255) == _END) & word[pairs >> 8]
    rows = [(-1, cell, b"", b"", b"", int(total[ends].sum()), int((total[ends] > 0).sum()))]
    many = first[which + 1] - first[which]
    ends = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    cuts = np.concatenate([[0], np.cumsum(many)])[ends]
    at = _flat(first[which], many)
    packed = _packed([many.astype("<u2"), (pairs & 255).astype(np.uint8)[at], total[at]], [ends, cuts, cuts])
    sizes = np.column_stack([sizes, np.diff(cuts)]).astype("<i4")
    rows += [(number, cell, own.tobytes(), data, fit, 0, 0) for number, own, data in zip(block, sizes, packed, strict=True)]
    return _table(rows, _BACK)


_SCORED = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "log2": pa.float64()}


def _tables(block: Block, back: pa.Table, n: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The counts of a block's contexts over all training documents, and what all blocks learnt."""
    back = back.sort_by("cell")
    kinds = len(block.contexts)
    fit = np.zeros((GATES, FIT), np.int64)
    cells, sizes, data, fits = (back.column(k).to_pylist() for k in ("cell", "sizes", "data", "fit"))
    for c, own in zip(cells, fits, strict=True):
        if own:
            fit[c::n] = np.frombuffer(own, "<i8").reshape(-1, FIT)
    sizes = np.frombuffer(b"".join(sizes), "<i4").reshape(len(cells), kinds + 1)
    own = np.column_stack([sizes[:, :-1].sum(axis=1)] + [sizes[:, -1]] * 2).tolist()
    follow, rank, count = _unpacked(data, own, ("<u2", "u1", "<i8"))
    follow = follow.astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(sizes[:, :-1].ravel(), dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(follow)])[cut].tolist()
    cut, out = cut.tolist(), []
    for k in range(kinds):
        own = range(k, len(cut) - 1, kinds)
        many = np.concatenate([follow[cut[i] : cut[i + 1]] for i in own])
        out.append((np.repeat(np.arange(len(many)), many) * 256 + np.concatenate([rank[ends[i] : ends[i + 1]] for i in own]), np.concatenate([count[ends[i] : ends[i + 1]] for i in own])))
    return out, fit


def _score(n: int):
    def score(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            total = [[None], [None], [sum(back.column("tokens").to_pylist())], [sum(back.column("kinds").to_pylist())], [None], [None]]
            return pa.table({k: pa.array(v, kind) for (k, kind), v in zip(_SCORED.items(), total, strict=True)})
        block, held = _parsed(t)
        tables, fit = _tables(block, back, n)
        log2 = Mixer(fit).texts(block, tables, held)
        # A word's count is that of its end.
        end = block.pairs[0][block.steps[block.unit[1 : block.n_words + 1] - 1]]
        key, count = tables[0]
        at = np.minimum(np.searchsorted(key, end), max(len(key) - 1, 0))
        known = count[at] * (key[at] == end) if len(key) else np.zeros(len(end))
        sums = np.bincount(block.doc, np.log10(known + 0.1)[block.token], len(held))
        values = (t.column("doc_id"), t.column("held_out"), block.size, np.bincount(block.doc, (known > 0)[block.token], len(held)).astype(np.int64), sums, log2)
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, kind) for (k, kind), v in zip(_SCORED.items(), values, strict=True)})

    return score


def score_texts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are the words between ASCII white space with A-Z folded, then one end.  Null counts as empty: one token,
    the end.  The base is the sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))), c being the token's count, N all and V the distinct
    tokens of documents that aren't held out.  Without training documents N and V are 0.  Rows without an id are
    trained on; repeated rows are counted and scored each on its own; other columns are ignored.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("held_out", is_held_out("doc_id"))
    size, ends = docs.agg(F.sum(F.octet_length("text") + 1), F.sum(F.when(~F.col("held_out"), 1))).first()
    blocks, ends = max(1, -(-int(size or 0) // block_bytes)), int(ends or 0)
    cells = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The same exchange serves both passes over the texts.
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(cells, "block")
    back = dealt.groupBy("block").applyInArrow(_send(cells), _SENT).groupBy("cell").applyInArrow(_add, _BACK)
    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, log2 double"
    sums = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(cells), scored).checkpoint()
    words, distinct = sums.where("base is null").agg(F.sum("n_tokens"), F.sum("n_known")).first()
    total, kinds = int(words or 0) + ends, int(distinct or 0) + (ends > 0)
    denominator = math.log10(total + 0.1 * (kinds + 1))
    base = F.col("base") + math.log10(ends + 0.1) - (F.col("n_tokens") + 1) * F.lit(denominator)
    rows = sums.where("base is not null")
    return rows.select("doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log2") / F.lit(math.log2(10))).alias("score"))
