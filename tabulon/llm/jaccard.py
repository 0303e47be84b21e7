"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct 5-word shingles.  Documents with equal sets form a class, and one
document stands for it.  The global order of shingles (that of their hashes) is cut into fragments; overlaps are counted
in each fragment on its own and summed per pair of documents:

1. Filter.  A pair that links shares four fifths of either set.  For half of the order it is counted how many
   shingles of each document occur in another one; a document with too many that don't can't link.
2. Candidates.  For the documents left, the order is cut into pieces of four shingles or so, more of them than two documents that link can differ in.
   One piece at least is the same in both, so documents that share no whole piece, not even through others, are never compared.  That
   asks for several shingles at once: documents made of the same common passages share many shingles, but hardly a piece.
3. Overlaps with the first.  Every document of a candidate group is paired with the group's first one.  Sets are cut into
   ``FRAGMENTS`` pieces, pieces of one fragment meet by a join, and the partial overlaps are summed per pair.  This is linear
   in the group, and of a group of near copies it leaves but those that aren't linked to the first.
4. Overlaps of the rest.  The documents that it leaves are compared with each other and with those that are linked (which are not compared
   among themselves any more).  Where few pairs of a group have a piece in common, as among documents made of the same passages, these pairs are looked at
   one by one: partial overlaps are summed per pair.  Where most have, as among near copies, both are dealt into blocks, and for each pair of blocks the overlaps of all pairs are summed
   fragment by fragment as products of incidence matrices.  A block pair returns a spanning forest of its links, at most one
   edge per document, never the pairs.
5. Components of the links.

A group of near copies that holds a third of all rows so sends its sets once, and again for each ``BLOCK`` documents that aren't
linked to its first one.  Only a group most of whose documents share whole pieces without linking to the first costs the square
of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkernel as tk
from .components import connected
from .exact import first_of_equal, row_key

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Pieces of a set, by ranges of the shingles' hash.
FRAGMENTS = 8
#: Documents of a candidate group compared at once, and shingles of a fragment in an incidence matrix.
BLOCK = 1024
FRAGMENT = 2048
#: Shingles whose signatures are settled among each other before they are sent.
SLICE = 1 << 20
#: How many pairs of a block are compared at the cost of one that is looked at alone.
PAIR = 8
#: Share of the hash range that the first filter looks at.
FILTER_BELOW = np.uint64(1 << 63)
_OTHER = np.uint64(0xA24BAED4963EE407)


def least_shared(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many shingles a set of n shares at least with any set that it links to."""
    return -(-percent * n // 100)


class Sets:
    """The shingle sets of a group of texts: hashes ``g`` of text d at ``first[d]:first[d + 1]``, sorted."""

    def __init__(self, w: tk.Words, k: int) -> None:
        n = w.hi - w.lo
        starts = tk.gram_starts(w.first, k)
        g = tk.grams(w.h, k)[starts] if len(starts) else np.empty(0, np.uint64)
        doc = np.searchsorted(w.first, starts, "right") - 1
        size = np.diff(w.first)
        short = np.flatnonzero((size > 0) & (size < k))
        whole = np.array([tk.grams(w.h[w.first[d] : w.first[d + 1]], int(size[d]))[0] for d in short.tolist()], np.uint64)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        self.g, self.doc = g[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        self.n = np.diff(self.first)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each set."""
        out = []
        for salt in (np.uint64(0), _OTHER):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(self.g ^ salt))])
            out.append((total[self.first[1:]] - total[self.first[:-1]]).view(np.int64))
        return out[0], out[1]


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, Sets]]:
    for batch in batches:
        col = tk.column(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for w in tk.words(col, tk.SPACED_FOLDED, 4 * tk.GROUP_BYTES):
            yield ids[w.lo : w.hi], Sets(w, k)


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """One row for each different set in a group of texts: f1, f2, n, members (documents, smallest first)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in _sets(batches, k):
            f1, f2 = s.prints()
            order = np.lexsort((ids, s.n, f2, f1))
            a, b, n, doc = f1[order], f2[order], s.n[order], ids[order]
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1])
            at = np.flatnonzero(head)
            members = pa.ListArray.from_arrays(pa.array(np.append(at, len(a)).astype(np.int32)), pa.array(doc.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(n[at].astype(np.int64)), members], names=["f1", "f2", "n", "members"])

    return docs.mapInArrow(scan, "f1 long, f2 long, n long, members array<long>")


def _possible(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Documents that have few enough shingles of their own, as far as half of the hash range shows."""
    n_cells = ex.cells(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in _sets(batches, k):
            f1, f2 = s.prints()
            order = np.lexsort((ids, f2, f1))
            head = np.ones(len(order), bool)
            head[1:] = (f1[order][1:] != f1[order][:-1]) | (f2[order][1:] != f2[order][:-1])
            # Of equal sets the smallest document goes on, as in the classes.
            lead = order[head]
            alone = np.zeros(len(s.n), bool)
            alone[lead] = True
            use = np.flatnonzero((s.g < FILTER_BELOW) & alone[s.doc])
            g, doc = s.g[use], ids[s.doc[use]].astype(np.int64)
            _, at, which, count = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
            own = np.bincount(s.doc[use], minlength=len(s.n))
            local = np.bincount(s.doc[use], count[which] > 1, len(s.n)).astype(np.int64)
            # What it lacks so far, so that the sum with later finds is the number of shingles no one shares.
            spare = s.n - least_shared(s.n, percent)
            d = ids[lead].astype(np.int64)
            yield ex.packed(2, ex.home(d, n_cells), [d, (spare + local - own)[lead].astype(np.int64)], 2)
            once, several = at[count == 1], at[count > 1]
            low = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cell = ex.cell_of(g, n_cells)
            order = once[np.argsort(s.doc[use][once], kind="stable")]
            yield ex.packed(0, cell[order], [low[order], doc[order]], 2)
            yield ex.packed(1, cell[several], [low[several]], 2)

    def reduce(kinds: dict[int, list[list[bytes]]]) -> Iterator[pa.RecordBatch]:
        one = kinds.get(0, [])
        g, doc = ex.array_of(one, 0, np.uint32), ex.array_of(one, 1, np.int64)
        known = ex.array_of(kinds.get(1, []), 0, np.uint32)
        order = np.argsort(g, kind="stable")
        ordered = g[order]
        again = np.zeros(len(g), bool)
        same = ordered[1:] == ordered[:-1]
        again[order[1:][same]] = again[order[:-1][same]] = True
        again |= np.isin(g, known)
        found, count = np.unique(doc[again], return_counts=True)
        two = kinds.get(2, [])
        found, count = np.concatenate([found, ex.array_of(two, 0, np.int64)]), np.concatenate([count, ex.array_of(two, 1, np.int64)])
        yield ex.packed(0, ex.home(found, n_cells), [found, count.astype(np.int64)], 2)

    def finish(doc: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        docs, which = np.unique(doc, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(docs[np.bincount(which, values[0]) >= 0])], names=["doc"])

    found = ex.exchanged(docs.mapInArrow(scan, ex.schema(2)), n_cells, reduce, ex.schema(2))
    return ex.gathered(found, n_cells, [np.int64], finish, "doc long")


class Sizes:
    """Size classes, and into how many pieces their members cut the order of shingles.

    Two sets of a and b shingles that link differ in at most (100 - percent) / (100 + percent) of a + b.  A pair belongs to the class of its larger set,
    and in a class everyone cuts the order at the same places, into more pieces than a pair of it can differ in.
    """

    def __init__(self, percent: int) -> None:
        least = [1]
        while least[-1] < 1 << 44:
            least.append(least[-1] + least[-1] // 8 + 1)
        self.percent = percent
        self.least = np.array(least, np.int64)
        self.most = self.least[1:] - 1
        differ = self._differ(2 * self.most)
        self.pieces = differ + 3 * differ // 10 + 2

    def _differ(self, both: np.ndarray) -> np.ndarray:
        return (100 - self.percent) * both // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.least, n, "right") - 1

    def largest(self, n: np.ndarray) -> np.ndarray:
        """The size of the largest set that one of n shingles links to."""
        return 100 * n // self.percent

    def differ(self, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many shingles a set of n may differ from one that it links to, if the larger one is of this class."""
        return self._differ(n + np.minimum(self.most[size], self.largest(n)))


def signatures(sizes: Sizes, n: np.ndarray, g: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of which two sets that link, but aren't equal, have one in common, with the places of their sets.

    Set i has n[i] shingles, which are those of ``g`` (sorted within a set) where ``at`` is i.  The order is cut into pieces.  If a set fills more of them with two or
    more shingles than can differ, one of these is the same in both.  A set that doesn't gives its pieces of one shingle as well, and one that fills
    too few even with these (a matter of small ones) its single shingles; two sets that both fall short of a step meet on the next.
    """
    low, high = sizes.of(n), sizes.of(sizes.largest(n))
    salted = tk.mix(g ^ _OTHER)
    for up in range(int((high - low).max(initial=-1)) + 1):
        size = np.minimum(low + up, high)
        differ = sizes.differ(n, size)
        # Equal sets stand for each other already, so where nothing may differ there is nothing to find.
        use = np.flatnonzero(((low + up <= high) & (differ > 0))[at])
        if not len(use):
            continue
        doc = at[use]
        name = tk.mix(size.astype(np.uint64) + np.uint64(1))
        piece = ((g[use] >> np.uint64(32)) * sizes.pieces[size].astype(np.uint64)[doc]) >> np.uint64(32)
        head = np.ones(len(use), bool)
        head[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(head)
        owner = doc[begin]
        several = np.diff(np.append(begin, len(use))) > 1
        short = np.bincount(owner[several], minlength=len(n)) <= differ
        keep = several | short[owner]
        yield tk.mix(np.add.reduceat(salted[use], begin) ^ tk.mix(name[owner] + piece[begin]))[keep], owner[keep]
        single = np.flatnonzero((np.bincount(owner, minlength=len(n)) <= differ)[doc])
        yield tk.mix(g[use[single]] + name[doc[single]]), doc[single]


def _meet(sig: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each signature with its smallest document and its number of documents, and (document, smallest one) of all others that have it."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    first = doc[head][np.cumsum(head) - 1]
    other = np.flatnonzero(doc != first)
    total = np.add.reduceat(count[order], np.flatnonzero(head)) if len(sig) else count
    return sig[head], doc[head], total, np.unique(np.stack([doc[other], first[other]], axis=1), axis=0)


def _starred(pairs: np.ndarray) -> np.ndarray:
    """Pairs (document, smaller one) that connect the same documents: each with the smallest it has, which the others it has are handed to."""
    for _ in range(2):
        pairs = np.unique(pairs, axis=0)
        if not len(pairs):
            break
        head = np.append(True, pairs[1:, 0] != pairs[:-1, 0])
        first = pairs[head, 1][np.cumsum(head) - 1]
        pairs = np.concatenate([pairs[head], np.stack([pairs[~head, 1], first[~head]], axis=1)])
    return np.unique(pairs, axis=0)


def _signed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Signatures of a slice of documents, the rows of the batch that have them, and the batch (doc, n, g, ...)."""
    sizes = Sizes(percent)
    for batch in batches:
        size, raw = batch.column("n").to_numpy(), batch.column("g")
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1):
            if len(part):
                g = np.frombuffer(b"".join(raw[i].as_py() for i in part.tolist()), np.uint64)
                found = list(signatures(sizes, size[part], g, np.repeat(np.arange(len(part)), size[part])))
                if found:
                    yield np.concatenate([x for x, _ in found]), part[np.concatenate([x for _, x in found])], batch


def _candidates(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """u, v, pairs, most: documents that have a signature in common with a smaller one, each with the smallest of these in a block of documents or of all.

    Rows with u = v say how many pairs the signatures have whose smallest document this is, and how many documents the commonest of them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, row, batch in _signed(batches, percent):
            # What a whole group of near copies shares is settled here, and sends one row on.
            sig, first, count, near = _meet(sig, batch.column("doc").to_numpy()[row], np.ones(len(sig), np.int64))
            yield ex.packed(0, ex.cell_of(sig, n), [sig, first, count], 3)
            near = _starred(near)
            yield ex.packed(1, ex.home(near[:, 0], n), [near[:, 0], near[:, 1]], 3)

    def reduce(kinds: dict[int, list[list[bytes]]]) -> Iterator[pa.RecordBatch]:
        rows, near = kinds.get(0, []), kinds.get(1, [])
        _, first, count, found = _meet(*(ex.array_of(rows, i, t) for i, t in enumerate((np.uint64, np.int64, np.int64))))
        found = _starred(np.concatenate([found, np.stack([ex.array_of(near, i, np.int64) for i in (0, 1)], axis=1)]))
        shared = np.flatnonzero(count > 1)
        shared = shared[np.argsort(first[shared], kind="stable")]
        first, count = first[shared], count[shared]
        begin = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.empty(0, int)
        lead, none = first[begin], np.zeros(len(found), np.int64)
        pairs = np.add.reduceat(count * (count - 1.0) / 2, begin) if len(begin) else np.empty(0)
        most = np.maximum.reduceat(count, begin) if len(begin) else np.empty(0, np.int64)
        columns = [np.append(found[:, 0], lead), np.append(found[:, 1], lead), np.append(none.astype(float), pairs), np.append(none, most)]
        yield ex.packed(0, ex.home(columns[0], n), columns, 4)

    def finish(u: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        v, pairs, most = values
        own = np.flatnonzero(u == v)
        begin = np.flatnonzero(np.append(True, np.diff(u[own]) != 0)) if len(own) else own
        near = _starred(np.stack([u, v], axis=1)[u != v])
        lead, none = u[own][begin], np.zeros(len(near), np.int64)
        total = np.add.reduceat(pairs[own], begin) if len(own) else pairs[own]
        largest = np.maximum.reduceat(most[own], begin) if len(own) else most[own]
        columns = [np.append(near[:, 0], lead), np.append(near[:, 1], lead), np.append(none.astype(float), total), np.append(none, largest)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v", "pairs", "most"])

    # A pair turns up in many cells; at the documents' own cells it is one row.
    found = ex.exchanged(sets.select("doc", "n", "g").mapInArrow(scan, ex.schema(3)), n, reduce, ex.schema(4))
    return ex.gathered(found, n, [np.int64, np.float64, np.int64], finish, "u long, v long, pairs double, most long")


def _pairs(members: DataFrame, n: int, percent: int) -> DataFrame:
    """u, v: pairs of documents (doc, n, g, linked) that have a signature in common, but for those that are both linked already."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, row, batch in _signed(batches, percent):
            linked = batch.column("linked").to_numpy(zero_copy_only=False).astype(np.int8)
            yield ex.packed(0, ex.cell_of(sig, n), [sig, batch.column("doc").to_numpy()[row], linked[row]], 3)

    def reduce(kinds: dict[int, list[list[bytes]]]) -> Iterator[pa.RecordBatch]:
        sig, doc, linked = (ex.array_of(kinds[0], i, t) for i, t in enumerate((np.uint64, np.int64, np.int8)))
        order = np.lexsort((doc, sig))
        sig, doc, linked = sig[order], doc[order], linked[order]
        # Pairs at distance 1, 2, ... in the postings, until none is long enough.
        at, far = np.arange(len(sig)), 1
        while True:
            at = at[at + far < len(sig)]
            at = at[sig[at] == sig[at + far]]
            if not len(at):
                return
            new = at[(doc[at] != doc[at + far]) & ((linked[at] == 0) | (linked[at + far] == 0))]
            found = np.unique(np.stack([doc[new + far], doc[new]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])
            far += 1

    return ex.exchanged(members.select("doc", "n", "g", "linked").mapInArrow(scan, ex.schema(3)), n, reduce, "u long, v long").distinct()


def _linked_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that link: overlaps are counted in each fragment and summed per pair."""
    pieces = members.select("component", "doc", "n", "g").mapInArrow(_pieces, "component long, fragment int, doc long, n long, piece binary")
    left = pieces.select(F.col("doc").alias("u"), F.col("n").alias("a"), "fragment", "piece")
    right = pieces.select(F.col("doc").alias("v"), F.col("n").alias("b"), "fragment", F.col("piece").alias("first"))
    met = pairs.join(left, "u").join(right, ["v", "fragment"]).select(F.struct("u", "v", "a", "b").alias("doc"), "piece", "first")
    shared = met.mapInArrow(_partial, "doc struct<u long, v long, a long, b long>, shared long").groupBy("doc").agg(F.sum("shared").alias("o"))
    return shared.where(f"o > 0 and 100 * o >= {percent} * (doc.a + doc.b - o)").select("doc.u", "doc.v")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sets (component, doc, n, g) at the borders of the fragments: component, fragment, doc, n, piece."""
    edges = np.array([k * (2**64 // FRAGMENTS) for k in range(1, FRAGMENTS)], np.uint64)
    for batch in batches:
        rows: list[tuple] = []
        for component, doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("component", "doc", "n", "g")), strict=True):
            g = np.frombuffer(raw, np.uint64)
            cut = np.searchsorted(g, edges).tolist()
            rows += [(component, f, doc, n, raw[8 * a : 8 * b]) for f, (a, b) in enumerate(zip([0, *cut], [*cut, len(g)], strict=True)) if b > a]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["component", "fragment", "doc", "n", "piece"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of pairs of pieces."""
    for batch in batches:
        pairs = zip(batch.column("piece").to_pylist(), batch.column("first").to_pylist(), strict=True)
        shared = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(shared, pa.int64())], names=["doc", "shared"])


def _near_first(members: DataFrame, percent: int) -> DataFrame:
    """doc, component, linked: is a document of a group linked to the group's first one (which is its component)?"""
    pieces = members.select("component", "doc", "n", "g").mapInArrow(_pieces, "component long, fragment int, doc long, n long, piece binary")
    first = pieces.where("doc = component").select("component", "fragment", F.col("piece").alias("first"))
    shared = pieces.where("doc <> component").join(first, ["component", "fragment"]).select("doc", "piece", "first").mapInArrow(_partial, "doc long, shared long")
    shared = shared.groupBy("doc").agg(F.sum("shared").alias("shared"))
    sizes = members.select("doc", "component", "n")
    leads = sizes.where("doc = component").select("component", F.col("n").alias("m"))
    rows = sizes.join(leads, "component").join(shared, "doc", "left")
    o = F.coalesce("shared", F.lit(0))
    linked = (F.col("doc") == F.col("component")) | ((100 * o >= percent * (F.col("n") + F.col("m") - o)) & (o > 0))
    return rows.select("doc", "component", linked.alias("linked"))


def _links(percent: int):
    def compare(key: tuple, t: pa.Table) -> pa.Table:
        """A spanning forest of the links between two blocks (or within one)."""
        low, high = key[1].as_py(), key[2].as_py()
        doc, n, block = (t.column(x).to_numpy() for x in ("doc", "n", "block"))
        grams = [np.frombuffer(x, np.uint64) for x in t.column("g").to_pylist()]
        rows = np.repeat(np.arange(len(doc)), [len(x) for x in grams])
        names, which, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        # The order of shingles is cut into fragments; overlaps are partial sums over them.
        rank = np.cumsum(count > 1) - 1
        use = count[which] > 1
        rows, column = rows[use], rank[which[use]]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        place = np.zeros(len(doc), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        overlap = np.zeros((len(left), len(right)), np.int64)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, FRAGMENT):
            a, b = np.searchsorted(column, [begin, begin + FRAGMENT])
            r, c = rows[a:b], column[a:b] - begin
            part = []
            for side, size in ((low, len(left)), (high, len(right))):
                own = block[r] == side
                m = np.zeros((size, FRAGMENT), np.float32)
                m[place[r[own]], c[own]] = 1
                part.append(m)
            # A fragment's products are small whole numbers, which float32 holds exactly; their sum needs more.
            overlap += (part[0] @ part[1].T).astype(np.int64)
        union = n[left][:, None] + n[right][None, :] - overlap
        linked = (100 * overlap >= percent * union) & (overlap > 0)
        label = doc.astype(np.int64).copy()
        big = np.int64(2**63 - 1)
        while True:
            a = np.minimum(label[left], np.where(linked, label[right][None, :], big).min(axis=1, initial=big))
            label[left] = np.minimum(label[left], a)
            b = np.minimum(label[right], np.where(linked, label[left][:, None], big).min(axis=0, initial=big))
            before = label[right].copy()
            label[right] = np.minimum(label[right], b)
            if (label[right] == before).all() and (np.minimum(label[left], np.where(linked, label[right][None, :], big).min(axis=1, initial=big)) == label[left]).all():
                break
        moved = label != doc
        return pa.table({"u": doc[moved].astype(np.int64), "v": label[moved]})

    return compare


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set), component_id.

    Words lie between ASCII white space, with A-Z folded; a text of fewer than ``shingle`` words is one shingle as
    a whole.  Null and empty texts have an empty set and link with nothing.  Two documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable by links.
    Rows without an id come back with component_id null, unlinked.  Rows that share an id count as one document with
    several texts.  An empty table gives no rows; other columns are ignored.
    """
    everything = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = everything.where("doc_id is not null")
    classes = _classes(docs, shingle).checkpoint()
    reps = classes.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.col("members")[0]).alias("rep"))
    possible = _possible(docs, shingle, percent).join(reps.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi")
    n = ex.cells(docs)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in _sets(batches, shingle):
            f1, f2 = s.prints()
            raw = [s.g[a:b].tobytes() for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(s.n.astype(np.int64)), pa.array(f1), pa.array(f2), pa.array(raw, pa.binary())], names=["doc", "n", "f1", "f2", "g"])

    texts = docs.join(possible, F.col("doc_id") == F.col("doc"), "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(shingles, "doc long, n long, f1 long, f2 long, g binary").where("n > 0")
    # Whole blocks lie together, so that a block sends a row per cell; removing repeated rows keeps this partitioning.
    sets = sets.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int")).repartition(n, "block")
    sets = sets.dropDuplicates(["block", "doc", "f1", "f2"]).drop("f1", "f2").checkpoint()
    candidates = _candidates(sets, n, percent).checkpoint()
    group = connected(candidates.select("u", "v")).checkpoint()
    members = sets.drop("block").join(group.select(F.col("node").alias("doc"), "component"), "doc")
    near = _near_first(members, percent).checkpoint()
    counts = near.groupBy("component").agg(F.count_if(~F.col("linked")).alias("r"), F.count_if(F.col("linked")).alias("l")).where("r > 0")
    asked = candidates.where("u = v").join(group, F.col("u") == F.col("node")).groupBy("component").agg(F.sum("pairs").alias("pairs"), F.max("most").alias("most"))
    # Both ways find the same links; a pair costs more where it is looked at alone.
    alone = (F.col("most") <= BLOCK) & (F.col("pairs") * PAIR <= F.col("r") * (F.col("r") + F.col("l")))
    counts = counts.join(asked, "component").withColumn("alone", alone).checkpoint()
    few = members.join(near.select("doc", "linked"), "doc").join(counts.where("alone").select("component"), "component", "left_semi").checkpoint()
    lone = _linked_pairs(_pairs(few, n, percent), few, percent)
    role = F.when(F.col("linked"), "linked").otherwise("rest")
    size = counts.where("not alone").select("component", F.ceil(F.col("r") / BLOCK).cast("int").alias("rests"), F.ceil(F.col("l") / BLOCK).cast("int").alias("links"))
    # Blocks of the rest come first; they meet all blocks, those of linked documents only them.
    own = F.pmod(F.xxhash64(F.col("doc") + 1), F.when(role == "rest", F.col("rests")).otherwise(F.col("links"))) + F.when(role == "rest", 0).otherwise(F.col("rests"))
    last = F.when(role == "rest", F.col("rests") + F.col("links")).otherwise(F.col("rests")) - 1
    dealt = near.join(size, "component").select("doc", "component", own.cast("int").alias("own"), F.sequence(F.lit(0), last).alias("others"))
    dealt = sets.drop("block").join(dealt, "doc").withColumn("other", F.explode("others"))
    dealt = dealt.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.col("own").alias("block"), "doc", "n", "g")
    links = dealt.groupBy("component", "low", "high").applyInArrow(_links(percent), "u long, v long")
    links = links.unionByName(lone).unionByName(near.where("linked and doc <> component").select(F.col("doc").alias("u"), F.col("component").alias("v")))
    linked = connected(links).select(F.col("node").alias("rep"), "component")
    named = classes.join(reps, ["f1", "f2", "n"], "left").join(linked, "rep", "left")
    rows = named.select("n", F.coalesce("component", "rep").alias("class"), F.explode("members").alias("doc_id"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))
    lost = everything.where("doc_id is null").select("doc_id", "text").mapInArrow(_sizes(shingle), "doc_id long, n_shingles long, component_id long")
    return rows.unionByName(lost)


def _sizes(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tk.words(tk.column(batch.column(1)), tk.SPACED_FOLDED):
                n = w.hi - w.lo
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(Sets(w, k).n.astype(np.int64)), pa.nulls(n, pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return scan


def drop_near(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each group, with all columns: the smallest id, then rows without one.

    Every row goes by its own text.  Where ids repeat or lack, rows are numbered in the order of (id, sha256 of
    the text) and linked by these numbers; texts without shingles link with nothing and all stay.
    """
    ids = documents.select(F.col(doc_id).cast("long").alias("i"))
    if not ids.groupBy("i").count().where("i is null or count > 1").take(1):
        kept = near_duplicates(documents, doc_id=doc_id, text=text).where("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
        return documents.join(kept, documents[doc_id] == kept["_kept"], "left_semi")
    key = row_key(doc_id, text)
    own = documents.withColumns(key)
    # Sorted as a whole, so numbers grow with the key; fixed by the checkpoint.
    numbered = own.select(*key).distinct().orderBy(F.desc("_has"), "_id", "_raw").withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    place = first_of_equal(own, list(key))
    texts = own.select(*key, F.col(text).cast("string").alias("_text")).dropDuplicates(list(key)).join(numbered, list(key)).select("_row", "_text")
    kept = near_duplicates(texts, doc_id="_row", text="_text").where("doc_id = component_id").select(F.col("doc_id").alias("_row"), "n_shingles").join(numbered, "_row")
    kept = kept.select(*key, F.col("n_shingles").alias("_n"))
    return own.withColumn("_k", place).join(kept, list(key)).where("_k = 1 or _n = 0").select(*documents.columns)
