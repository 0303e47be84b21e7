import hashlib
import pickle
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, exact, jaccard, substring

from .helpers import alnum, fold, rows_of, spaced, table, texts


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_substring(rows, window):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = spaced(t)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    for i, t in rows:
        w = spaced(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone |= set(range(s, s + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window", [20, 5, 2])
def test_substring_equals_brute_force(spark, window):
    rows = list(enumerate(texts(70, seed=window)))
    found = rows_of(substring.remove_repeats(table(spark, rows), window=window))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == plain_substring(rows, window)
    assert len(found) == len(rows)


def test_substring_repeats_within_one_text_and_local_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "LOCAL_BYTES", 300)
    line = " ".join(f"v{i}" for i in range(30))
    rows = [(0, f"{line} {line}\n{line}"), (1, line), (2, "a b"), (3, None)]
    found = {r["doc_id"]: r for r in rows_of(substring.remove_repeats(table(spark, rows, 2), with_text=True))}
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found.items()} == plain_substring(rows, 20)
    assert found[0]["kept_text"] == line and found[1]["kept_text"] == ""


def test_substring_levels_end(spark):
    words = [f"u{i}" for i in range(90)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:50])), (2, " ".join(words[:21])), (3, "other text")]
    levels = defaultdict(set)
    for r in rows_of(substring.repeat_levels(table(spark, rows), window=20)):
        levels[r["length"]].add(r["doc"])
    assert levels == {20: {0, 1, 2}, 40: {0, 1}}


def test_substring_without_rows_or_ids(spark):
    assert substring.remove_repeats(table(spark, [])).count() == 0
    long = " ".join(f"q{i}" for i in range(25))
    found = rows_of(substring.remove_repeats(table(spark, [(None, long), (4, long)])))
    assert {r["doc_id"]: r["n_removed"] for r in found} == {None: 0, 4: 25}


def plain_jaccard(rows, k=5, percent=80):
    sets = {}
    for i, t in rows:
        w = spaced(fold(t))
        sets[i] = {tuple(w[s : s + min(k, len(w))]) for s in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    near = {i: [j for j in ids if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(sets[i]), min(seen))
    return out


@pytest.mark.parametrize(("seed", "words", "block", "pair"), [(1, 400, 1024, 8), (2, 8, 1024, 8), (3, 400, 4, 8), (4, 8, 1024, 0)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, words, block, pair):
    monkeypatch.setattr(jaccard, "PAIR", pair)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FRAGMENT", 64)
    rows = list(enumerate(texts(90, seed=seed, words=words)))
    found = rows_of(jaccard.near_duplicates(table(spark, rows)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == plain_jaccard(rows)
    assert len(found) == len(rows)


def test_jaccard_ties_of_huge_sets():
    """Four fifths exactly, where 100 times the overlap is beyond what a single float holds."""
    import numpy as np
    import pyarrow as pa

    small, large = 268_436, 335_545
    g = np.sort(np.random.default_rng(0).choice(2**40, large, replace=False).astype(np.uint64))
    for n, want in ((small, 1), (small - 1, 0)):
        rows = pa.table({"component": [0, 0], "low": [0, 0], "high": [0, 0], "doc": [1, 2], "n": [n, large], "block": [0, 0], "g": [g[:n].tobytes(), g.tobytes()]})
        found = jaccard._links(80)((pa.scalar(0), pa.scalar(0), pa.scalar(0)), rows)
        assert found.num_rows == want


@pytest.mark.parametrize("pair", [8, 0])
def test_jaccard_group_of_near_copies(spark, monkeypatch, pair):
    """A large group of different near copies, some of which aren't linked to the first."""
    import random

    monkeypatch.setattr(jaccard, "PAIR", pair)
    monkeypatch.setattr(jaccard, "BLOCK", 8 if pair else 1024)
    r = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(120)] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(own)))
    found = rows_of(jaccard.near_duplicates(table(spark, rows)))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == plain_jaccard(rows)


@pytest.mark.parametrize("percent", [80, 60, 95])
def test_jaccard_linked_sets_share_a_signature(percent):
    """Pairs right at the limit, from the smallest sets on; most have their pieces in common by far more than one."""
    import numpy as np

    sizes = jaccard.Sizes(percent)
    r = np.random.default_rng(percent)

    def of(g):
        return set(np.concatenate([x for x, _ in jaccard.signatures(sizes, np.array([len(g)]), np.sort(g), np.zeros(len(g), int))] or [np.empty(0, np.uint64)]).tolist())

    linked = 0
    for n in [*range(1, 40), 100, 333, 1000]:
        for _ in range(30):
            base = r.integers(0, 2**64, 2 * n + 2, dtype=np.uint64)
            lost = int(r.integers(0, n - jaccard.least_shared(n, percent) + 1))
            # a has n shingles, of which b lacks some; b has as many others as the limit allows.
            more = max(0, 100 * (n - lost) // percent - n)
            a, b = base[:n], np.concatenate([base[lost:n], base[n : n + more]])
            shared, union = n - lost, n + more
            if 100 * shared >= percent * union and len(a) + len(b) > 2 * shared:
                linked += 1
                assert of(a) & of(b)
    assert linked > 300


@pytest.mark.parametrize("pair", [8, 10**9, 0])
def test_jaccard_pages_of_common_passages(spark, monkeypatch, pair):
    """Pages of 10 out of 200 passages; what share a piece is looked at pair by pair, or (0: always, 10**9: never) in blocks, with one result."""
    import random

    monkeypatch.setattr(jaccard, "PAIR", pair)
    r = random.Random(4)
    passages = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(200)]
    rows = [(i, " ".join(r.sample(passages, 10))) for i in range(1500)]
    rows += [(2000 + i, f"{rows[i][1]} other end") for i in range(20)]
    sets = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).mapInArrow(sets_of, "doc long, n long, g binary")
    pairs = jaccard._pairs(sets.withColumn("linked", F.lit(False)), 4, 80).collect()
    assert {(2000 + i, i) for i in range(20)} <= {tuple(p) for p in pairs} and len(pairs) < 0.02 * 1500 * 1500 / 2
    found = rows_of(jaccard.near_duplicates(table(spark, rows)))
    assert {x["doc_id"] for x in found if x["component_id"] != x["doc_id"]} == {2000 + i for i in range(20)}


def sets_of(batches):
    for batch in batches:
        for ids, s in jaccard._sets([batch], 5):
            raw = [s.g[a:b].tobytes() for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s.n), pa.array(raw, pa.binary())], names=["doc", "n", "g"])


def test_jaccard_empty_null_and_repeated_rows(spark):
    assert jaccard.near_duplicates(table(spark, [])).count() == 0
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "A  B c"), (8, ""), (9, None)]
    found = sorted(rows_of(jaccard.near_duplicates(table(spark, rows))), key=str)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 0, 8), (9, 0, 9)]
    assert [r for r in found if r["doc_id"] is None] == [{"doc_id": None, "n_shingles": 1, "component_id": None}]


def test_jaccard_keeps_first_of_group(spark):
    rows = [(3, " ".join(f"k{i}" for i in range(60))), (2, " ".join(f"k{i}" for i in range(1, 60))), (1, "else")]
    kept = jaccard.drop_near(table(spark, rows))
    assert {r["doc_id"] for r in rows_of(kept)} == {1, 2} and "values" in kept.columns


@pytest.mark.parametrize("block", [4096, 8, 1])
def test_exact_equals_brute_force(spark, block):
    rows = list(enumerate(t if t is None else t[:700] for t in texts(60, seed=block)))
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    want = {i: (max(groups[fold(t)]), len(groups[fold(t)]), i == max(groups[fold(t)]), sha(fold(t))) for i, t in rows}
    found = rows_of(exact.exact_duplicates(table(spark, rows), block=block))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found} == want
    assert len(found) == len(rows)


def test_exact_repeated_rows_null_ids_and_nothing(spark, monkeypatch):
    assert exact.exact_duplicates(table(spark, [])).count() == 0
    monkeypatch.setattr(exact, "FOLD_BYTES", 1)
    rows = [(4, "Same"), (4, "same"), (None, "SAME"), (1, None), (2, "")]
    found = rows_of(exact.exact_duplicates(table(spark, rows)))
    assert sum(r["kept"] for r in found) == 2 and len(found) == 5
    assert {(r["keep_id"], r["group_size"]) for r in found} == {(4, 3), (2, 2)}
    assert {r["doc_id"] for r in rows_of(exact.drop_exact(table(spark, [(1, "a"), (2, "A"), (3, "b")])))} == {2, 3}


def plain_decontamination(rows, items, window=10):
    windows = []
    for item, t in items:
        w = alnum(t)
        k = min(window, len(w))
        windows += [(str(item), tuple(w[s : s + k])) for s in range(len(w) - k + 1) if k]
    out = {}
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for item, g in windows:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found.add(item)
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


@pytest.mark.parametrize(("limit", "part"), [(32 << 20, 50_000), (300, 50_000), (300, 11)])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit, part):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    docs = texts(50, seed=9)
    items = [(1, docs[20]), (12, docs[21]), (2, "w1 w2"), (3, ""), (4, None), (5, "É"), (6, docs[20])]
    rows = list(enumerate(docs)) + [(900, "x " + (docs[20] or "").upper() + " y"), (901, "W1-W2, w1 w2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = rows_of(decontaminate.digest(decontaminate.decontaminate(table(spark, rows), benchmark, set_bytes=limit)))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found}
    assert got == plain_decontamination(rows, items) and len(found) == len(rows)


@pytest.mark.parametrize("limit", [32 << 20, 30])
def test_decontamination_repeated_rows_and_items_without_id(spark, limit):
    items = spark.createDataFrame([(None, "some secret words"), ("null", "other words"), ("null", "other words")], "item_id string, text string")
    rows = [(1, "other words and some secret words"), (1, "other words and some secret words"), (None, "Other-words"), (1, "clean")]
    found = rows_of(decontaminate.digest(decontaminate.decontaminate(table(spark, rows), items, set_bytes=limit)))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found)
    assert got == sorted([("1", 6, 5, 2, sha("null"))] * 2 + [("None", 2, 2, 1, sha("null")), ("1", 1, 0, 0, sha(""))])


def test_the_window_set_is_as_large_as_stated(spark):
    """The size by which slices are made bounds the arrays in memory, and what is pickled for the broadcast."""
    r = random.Random(5)
    few, many = [f"w{i}" for i in range(500)], [f"word{i:07d}" for i in range(200_000)]
    for pool in (few, many):
        parts = [(str(i), " ".join(r.choice(pool) for _ in range(r.choice([3, 40, 900])))) for i in range(400)]
        stated = sum(len(t.split()) * (decontaminate.WINDOW_BYTES + decontaminate.WORD_BYTES) + len(t) + len(i) + decontaminate.PART_BYTES for i, t in parts)
        made = decontaminate.WindowSet(pa.table({"i": [i for i, _ in parts], "t": [t for _, t in parts]}))
        assert made.nbytes < stated + 1024 and len(pickle.dumps(made)) < stated + 16384
    benchmark = spark.createDataFrame(parts, "item_id string, text string")
    slices = list(decontaminate._slices(benchmark, "item_id", "text", stated // 4, 10))
    assert len(slices) > 4 and sum(len(x) for x in slices) == len(parts)
    assert all(decontaminate.WindowSet(x).nbytes < stated // 4 for x in slices)


def test_decontamination_keeps_apart_words_whose_hashes_collide(spark, monkeypatch):
    """With hashes of four values, only the words themselves tell windows apart."""
    grams, scan = decontaminate.tk.grams, decontaminate.tk._scan
    monkeypatch.setattr(decontaminate.tk, "grams", lambda h, k: grams(h, k) % np.uint64(4))
    monkeypatch.setattr(decontaminate.tk, "_scan", lambda *a: (lambda h, *rest: (h % np.uint64(4), *rest))(*scan(*a)))
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(["aa", "Bb", "cc", "dé", "ee", "ff", "gg"]) for _ in range(n))
    items = [(str(i), say(n)) for i, n in enumerate([1, 2, 2, 3, 10, 10, 14, 40]) for _ in range(2)] + [("9", "zz")]
    docs = [say(n) for n in (0, 1, 5, 30, 30, 60)] + [f"{say(4)} {t} {say(4)}" for _, t in items]
    made = decontaminate.WindowSet(pa.table({"i": [i for i, _ in items], "t": [t.lower() for _, t in items]}))
    col = decontaminate.tk.column(pa.array(docs))
    got, n_hit = {}, 0
    for w in decontaminate.tk.words(col, decontaminate.tk.ALNUM_FOLDED):
        found, hit = [], np.zeros(len(w.h), bool)
        for at, own, which in made.occurrences(col, w):
            hit |= decontaminate.tk.covered(len(hit), at, own.size)
            found.append((np.searchsorted(w.first, at, "right") - 1, own, which))
        got |= dict(enumerate(made.items(w.hi - w.lo, found).to_pylist(), w.lo))
        n_hit += int(hit.sum())
    want = plain_decontamination(list(enumerate(docs)), items)
    assert {i: (len(x), sha(",".join(x))) for i, x in got.items()} == {i: v[2:4] for i, v in want.items()}
    assert n_hit == sum(v[1] for v in want.values())


def test_decontamination_without_items_and_removal(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in rows_of(decontaminate.digest(decontaminate.decontaminate(table(spark, [(1, "a"), (2, None)]), none)))} == {False}
    one = spark.createDataFrame([(1, "secret phrase here")], "item_id long, text string")
    left = decontaminate.without_benchmark(table(spark, [(1, "the Secret, phrase here"), (2, "secret phrase"), (3, None)]), one)
    assert {r["doc_id"] for r in rows_of(left)} == {2, 3} and left.columns == table(spark, []).columns


def test_word_hash_tells_regular_words_apart():
    import pyarrow as pa

    from tabulon.llm import textkernel as tk

    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    words = [w for n in (64, 1024, 2048, 4096) for w in (thue[:n], thue[:n].translate(str.maketrans("ab", "ba")))]
    for second in (False, True):
        found = next(tk.words(tk.column(pa.array([" ".join(words)])), tk.SPACED, second=second))
        assert len(set(found.h.tolist())) == len(words) and len(set(found.h2.tolist())) == len(words) * second
    h = found.h
    two = [h[0] if c == "a" else h[1] for c in thue[:1024]]
    other = [h[1] if c == "a" else h[0] for c in thue[:1024]]
    import numpy as np

    assert tk.grams(np.array(two), 1024)[0] != tk.grams(np.array(other), 1024)[0]
    rows = np.arange(30, dtype=np.uint64)
    assert all(len(set(tk.grams(rows % np.uint64(7), k).tolist())) == min(7, 31 - k) for k in (1, 2, 3, 5, 10, 20, 29))
