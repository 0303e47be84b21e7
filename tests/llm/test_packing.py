import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import packing, wordbpe
from tabulon.llm import textkernel as tk

from .helpers import rows_of, table, texts


@pytest.fixture(scope="module")
def bpe():
    return wordbpe.load(packing.tokenizer_path())


def ids_of(bpe, made):
    col, out = tk.column(pa.array(made, pa.string())), []
    for w in tk.words(col, tk.SPACED):
        flat, counts = bpe.ids(col, w)
        ends = np.cumsum(counts)
        out += [flat[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]
    return out


def test_ids_are_the_library_s(bpe):
    made = texts(40, seed=3) + ["Hello, World! it's 2024 <|endoftext|> ÀÉß café “quoted” 日本語\u00a0x a×b÷c İ e\u0301", "don't I'll #1 foo_bar(baz) <b> \x00 \x1c", "é" * 200, "A" * 500 + " " + "1" * 40]
    assert ids_of(bpe, made) == [bpe.library.encode(t or "", add_special_tokens=False).ids for t in made]


def test_memory_of_chunks_is_bounded(bpe, monkeypatch):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 30)
    made = texts(30, seed=8)
    assert ids_of(bpe, made) == [bpe.library.encode(t or "", add_special_tokens=False).ids for t in made]


def plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    lengths = [r.randint(1, capacity) for _ in range(400)]
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    used = defaultdict(list)
    for length, rank, n, first, per, offset in packing.best_fit_decreasing(dict(counts), capacity).tolist():
        for k in range(n):
            used[first + k // per].append((offset + (k % per) * length, length))
    rooms = []
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        rooms.append(capacity - at)
    assert sorted(rooms) == plain_best_fit(lengths, capacity)


def test_tightest_room():
    tree = packing.RoomTree(20)
    for room in (3, 9, 17):
        tree.set(room, True)
    assert [tree.tightest(x) for x in (1, 3, 4, 10, 18)] == [3, 3, 9, 17, None]


def test_pack_round_trip(spark, bpe):
    rows = list(enumerate(texts(50, seed=5))) + [(3, "repeated row"), (3, "repeated row"), (None, "no id")]
    capacity = 128
    packed = packing.pack(table(spark, rows), capacity=capacity, with_ids=True).cache()
    found = rows_of(packed)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*bpe.library.encode(t or "", add_special_tokens=False).ids, packing.END_ID])
    places, whole = defaultdict(list), defaultdict(dict)
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= capacity and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["start"] == r["piece"] * capacity
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] not in (3, None):
            whole[r["doc_id"]][r["piece"]] = ids.tolist()
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for i, pieces in whole.items():
        assert [x for p in sorted(pieces) for x in pieces[p]] == want[i][0]
    assert sorted(capacity - sum(n for _, n in s) for s in places.values()) == plain_best_fit([r["length"] for r in found], capacity)
    made = {r["sequence_id"]: r for r in rows_of(packing.sequences(packed))}
    assert set(made) == set(places) and all(len(r["ids"]) == 4 * r["length"] for r in made.values())
    assert packing.pack(table(spark, [])).count() == 0
