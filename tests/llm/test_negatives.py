import math
import random

from tabulon.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, cell int, dist double, v string"


def plain(rows):
    ok = []
    for i, x, label in rows:
        if None in (i, x, label) or any(c is None or not math.isfinite(c) for c in x):
            continue
        ok.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    anchors = {}
    for i, label, v in ok:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-dot(v, w), i, k) for i, k, w in ok if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            found = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(found)]
    return sorted(out)


def held(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], ROWS).repartition(3)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in negatives.hard_negatives(df, **kw).collect())


def vectors(n, seed=1, width=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        x = [float(round(a + r.gauss(0, 0.6), 2)) for a in c]
        rows.append((i, x if r.random() < 0.8 else [0.5] * width, r.choice([1, 1, 1, 2, 3, 9])))
    return rows


AWKWARD = [
    (None, [0.1] * 6, 1), (5000, None, 1), (5001, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (5002, [float("nan")] + [0.1] * 5, 1), (5003, [float("inf")] + [0.1] * 5, 2), (5004, [0.2] * 6, None),
    (5100, [0.0] * 6, 2), (5200, [], 3), (5300, [3.0, -2.0], 1), (5300, [3.0, -2.0], 1), (5300, [1.0, 2.0], 2), (5301, [30.0] * 6, 1), (5400, [-1.5] * 6, 9), (5500, [0.5] * 6, 77),
]


def test_equals_all_pairs(spark):
    rows = vectors(700) + AWKWARD
    want = plain(rows)
    assert len(want) > 100
    # Many pivots and small blocks: bounds and salts take part.
    assert held(spark, rows, per_pivot=1, block=40) == want
    assert held(spark, rows[::-1]) == want


def test_bounds_leave_rows_out(spark):
    """In clusters that lie apart, rows aren't sent to groups that they can't serve."""
    r = random.Random(4)
    rows = [(i, [(8.0 if i % 4 == k else 0.0) + r.gauss(0, 0.05) for k in range(4)], i % 4 % 2) for i in range(1200)]
    sent = []
    joined = negatives._joined
    negatives._joined = lambda s, *a: sent.append(s.count()) or joined(s, *a)
    try:
        assert held(spark, rows) == plain(rows)
    finally:
        negatives._joined = joined
    assert sent[0] < 2 * len(rows)


def test_empty(spark):
    assert held(spark, []) == [] == held(spark, [(100, None, 1)]) == held(spark, [(100, [1.0], 1)])
