import numpy as np

from tabulon.operators import resampling as rs


def test_counts_are_multinomial(spark):
    """Every resample draws as many units as there are; counts have the law's mean, variance and covariance, within a block and across blocks."""
    n, repeats = 37, 4000
    df = spark.createDataFrame([(k, i % n) for k in ("a", None) for i in range(2 * n)], "k string, u long").repartition(5)
    got = {(r.k, r.u): np.frombuffer(r.counts, np.uint32) for r in rs.resample_counts(df, ["k"], "u", repeats=repeats, seed=2, block=8).collect()}
    assert len(got) == 2 * n
    for k in ("a", None):
        w = np.array([got[k, u] for u in range(n)]).astype(float)
        assert (w[:, 0] == 1).all() and (w.sum(axis=0) == n).all()
        w = w[:, 1:]
        c = np.cov(w)
        assert abs(w.mean(axis=1) - 1).max() < 0.08 and abs(np.diag(c) - (1 - 1 / n)).max() < 0.12
        off = c[~np.eye(n, dtype=bool)]
        assert abs(off.mean() + 1 / n) < 0.005 and abs(off + 1 / n).max() < 0.1
    assert (got["a", 3] != got[None, 3]).any()


def test_results_are_the_same_for_any_partitioning(spark):
    rows = [(f"u{i % 300}", i % 7 == 0, float(i % 11), float(i * i % 13), 1.0 if i % 3 else None) for i in range(3000)] + [(None, True, 3.0, 2.0, 1.0)]
    found = set()
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "u string, y boolean, a double, b double, v double").repartition(parts)
        m = rs.grouped_bootstrap(df, [], "u", "v", repeats=50, block=32).first()
        d = rs.auroc_difference(df, [], "u", "y", "a", "b", repeats=50, block=32).first()
        assert d.low < d.difference < d.high and m["mean"] == m.low == 1.0
        found.add((*m, *(round(x, 12) for x in d)))
    assert len(found) == 1


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("b", 2.0, True)], "u string, x double, y boolean")
    r = rs.auroc_difference(df.withColumn("z", df.x), [], "u", "y", "x", "z", repeats=5).first()
    assert tuple(r) == (None, None, None)
    assert rs.grouped_bootstrap(df.limit(0), ["u"], "y", "x", repeats=5).count() == 0
