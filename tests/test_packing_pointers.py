import random

import pytest

from tabulon.operators import packing as pk


def fold(lengths, max_length, max_questions):
    out, seq, used, n = [], 0, 0, 0
    for x in lengths:
        if n and (used + x > max_length or n >= max_questions):
            seq, used, n = seq + 1, 0, 0
        out.append((seq, used))
        used, n = used + x, n + 1
    return out


@pytest.mark.parametrize(("max_length", "max_questions"), [(320, 4), (50, 1), (10, 1000)])
def test_pointers_equal_the_fold(spark, max_length, max_questions):
    r = random.Random(max_length)
    images = {None: 40, 1: 1, 2: 700, 3: 90, 4: 33, 5: 2}
    rows, want = [], {}
    for image, n in images.items():
        lengths = [r.choice([0, 0, 1, 3, 5, 90, 120, 400]) for _ in range(n)]
        order = sorted(r.sample(range(-50, 5000), n))
        rows += [(image, o, x, "more") for o, x in zip(order, lengths, strict=True)]
        want[image] = [(o, x, *f) for o, x, f in zip(order, lengths, fold(lengths, max_length, max_questions), strict=True)]
    df = spark.createDataFrame(rows, "image long, ord long, length int, seq string").repartition(4)
    for folded in (32, 4096):
        got = {k: [] for k in images}
        for x in pk.pack(df, max_length=max_length, max_questions=max_questions, folded=folded).collect():
            got[x.image].append((x.ord, x.length, x.seq, x.offset))
        assert {k: sorted(v) for k, v in got.items()} == want
    assert pk.pack(df.limit(0), folded=1).count() == 0
