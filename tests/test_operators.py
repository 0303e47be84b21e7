import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import calibration as cal
from tabulon.operators import labels as lb
from tabulon.operators import metrics as mt
from tabulon.operators import packing as pk
from tabulon.operators import reports as rp
from tabulon.operators import sampling as sm
from tabulon.operators import reuse as ru
from tabulon.operators import serving as sv
from tabulon.operators import ranking as rk
from tabulon.operators import similarity as sim

from . import plain


def near_hashes(n, seed=0):
    r, out = random.Random(seed), []
    for _ in range(n):
        h = r.getrandbits(64) if not out or r.random() < 0.5 else r.choice(out)
        for _ in range(r.randint(0, 5)):
            h ^= 1 << r.randrange(64)
        out.append(h)
    return out


def frame(spark, hashes):
    return spark.createDataFrame([(i, h - 2**64 if h >> 63 else h) for i, h in enumerate(hashes)], "id long, bits long")


@pytest.mark.parametrize("distance", [0, 4, 9, 16])
def test_banded_join_is_the_nested_loop(spark, distance):
    a, b = near_hashes(200, 1), near_hashes(150, 1)
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (x ^ y).bit_count() <= distance}
    assert {(r.l, r.r) for r in sim.hamming_pairs(frame(spark, a), frame(spark, b), distance=distance).collect()} == want
    assert {r.id for r in sim.near_any(frame(spark, a), frame(spark, b), distance=distance).collect()} == {i for i, _ in want}


def test_blocks_are_the_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(sim, "BLOCK", 16)
    monkeypatch.setattr(sim, "BATCH", 5)
    a, b = near_hashes(150, 2), near_hashes(90, 2)
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (x ^ y).bit_count() <= 17}
    found = sim.hamming_pairs(frame(spark, a), frame(spark, b), distance=17)
    assert {(r.l, r.r) for r in found.collect()} == want and found.count() == len(want)
    signed = lambda x: x - 2**64 if x >> 63 else x
    own = [frozenset((r.x, r.y)) for r in sim._near_within(frame(spark, a), 16).collect()]
    assert len(own) == len(set(own)) and set(own) == {frozenset((signed(x), signed(y))) for x in a for y in a if x != y and (x ^ y).bit_count() <= 16}


def test_wide_joins_make_no_candidate_rows(spark):
    v = spark.range(100).select("id", F.xxhash64("id").alias("bits"))
    assert "Generate explode(concat" not in sim.hamming_pairs(v, v, distance=16)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_rounds_are_the_loop(spark, seed):
    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(40), 2))) for _ in range(60)}
    kept = []
    for i in range(40):
        if not any((min(i, k), max(i, k)) in edges for k in kept):
            kept.append(i)
    nodes = spark.range(40)
    found = sim.greedy_keep(nodes, spark.createDataFrame(sorted(edges), "l long, r long"))
    assert sorted(x.id for x in found.where("kept").collect()) == kept


def test_greedy_rounds_with_groups(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["p", "q", "r", "s", None]), h) for i, h in enumerate(near_hashes(120, 5))]
    kept = []
    for i, p, h in rows:
        if not any((h ^ g).bit_count() <= 6 or (p is not None and p == o) for _, o, g in kept):
            kept.append((i, p, h))
    df = spark.createDataFrame([(i, p, h - 2**64 if h >> 63 else h) for i, p, h in rows], "id long, photo string, bits long")
    assert sorted(x.id for x in sim.keep_distinct(df, distance=6, group="photo").where("kept").collect()) == [i for i, _, _ in kept]
    alone = []
    for i, _, h in rows:
        if not any((h ^ g).bit_count() <= 6 for _, g in alone):
            alone.append((i, h))
    assert sorted(x.id for x in sim.keep_distinct(df, distance=6).where("kept").collect()) == [i for i, _ in alone]


def test_exclusion_causes(spark):
    images = spark.createDataFrame([(1, "p1", 0), (2, "p2", 1), (3, "p3", 2**40), (4, "p4", 2**40 + 1), (5, "p3", 2**50 - 1), (6, None, None)], "id long, photo string, bits long")
    evaluation = spark.createDataFrame([("p1", -1), ("zz", 3)], "photo string, bits long")
    assert {r.id: r.cause for r in sim.exclude_evaluation(images, evaluation).collect()} == {1: "photo", 2: "near", 3: "near", 4: "near", 5: None, 6: None}


def test_calibration_error_values(spark):
    rows = [("a", 0.7, float(i < 700)) for i in range(1000)] + [("b", 0.7, 1.0)] * 1000
    found = {r.g: r.ece for r in mt.calibration_error(spark.createDataFrame(rows, "g string, conf double, correct double"), ["g"]).collect()}
    assert abs(found["a"]) < 1e-9 and abs(found["b"] - 0.3) < 1e-9


def test_ranking_metrics(spark):
    rows = [("a", s, p) for s, p in ((0.9, True), (0.8, True), (0.2, False), (0.1, False))] + [("b", -s, p) for s, p in ((0.9, True), (0.8, True), (0.2, False), (0.1, False))] + [("c", 0.5, True), ("d", 0.5, True), ("d", 0.5, False)]
    found = {r.g: r.auroc for r in mt.auroc(spark.createDataFrame(rows, "g string, score double, positive boolean"), ["g"]).collect()}
    assert (found["a"], found["b"], found["d"]) == (1.0, 0.0, 0.5) and np.isnan(found["c"])
    risk = mt.risk_coverage(spark.createDataFrame([("a", 0.9, 1.0, 1), ("a", 0.1, 0.0, 2)], "g string, conf double, correct double, ord int"), ["g"], "ord").first()
    assert risk.aurc == 0.25


def test_correlations_compute_values_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def value(i):
        seen.add(1)
        return float(i * 7 % 10)

    items = spark.range(40).select((F.col("id") % 2).alias("g"), F.udf(value, "double")("id").alias("x"), (F.col("id") * 1.0).alias("y"))
    found = {r.g: r.srcc for r in mt.correlations(items, ["g"], "x", "y").collect()}
    assert seen.value == 40 and set(found) == {0, 1} and all(-1 <= v <= 1 for v in found.values())


def test_smooth_error_is_the_plain_one(spark):
    r = np.random.default_rng(0)
    conf = np.round(r.uniform(0.05, 0.95, 600), 3)
    good, bad = (r.uniform(size=600) < conf).astype(float), (r.uniform(size=600) < conf**2).astype(float)
    rows = [(g, float(c), float(y)) for g, ys in (("good", good), ("bad", bad), (None, bad)) for c, y in zip(conf, ys, strict=True)]
    found = {x.g: (x.n, x.smece) for x in mt.smooth_calibration_error(spark.createDataFrame(rows, "g string, conf double, correct double"), ["g"]).collect()}
    for g, y in (("good", good), ("bad", bad), (None, bad)):
        assert found[g][0] == 600 and abs(found[g][1] - plain.smooth_error(conf, y - conf)) < 1e-6
    assert found["good"][1] < 0.08 < found["bad"][1]


def test_moments_stand_for_kernels():
    r = np.random.default_rng(1)
    c = np.concatenate([[0.0, 1.0, 1e-5, 0.5, 0.5], r.uniform(size=300), r.beta(0.3, 0.3, 300)])
    resid = r.normal(size=len(c))
    cells = 2**mt.DEPTH
    k = np.minimum(np.floor(c * cells), cells - 1).astype(int)
    m = np.zeros((cells, mt.MOMENTS))
    for p in range(mt.MOMENTS):
        np.add.at(m[:, p], k, resid * ((c * cells - k - 0.5) * 2) ** p)
    grid, points, weights = np.linspace(0, 1, 501), np.concatenate([c, -c, 2 - c]), np.tile(resid, 3)
    levels = [m]
    while len(levels[-1]) > 4:
        levels.append(mt._coarser(levels[-1]))
    for width in (1e-4, 2e-4, 0.001, 0.03, 0.2, 0.9):
        curve = np.exp(-(((grid[:, None] - points) / width) ** 2) / 2) @ weights / (len(c) * width * np.sqrt(2 * np.pi))
        coarse = [x for x in levels if 2.0 / len(x) <= width] or levels[:1]
        assert abs(mt._smoothed_gap(coarse[-1], len(c), width) - np.trapezoid(np.abs(curve), grid)) < 1e-8


def test_ranges_are_windows(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([0.5, 1.5, r.random()]), i, r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, i long, w double")
    for x in rk.running(df, ["g"], ["v", "i"], {"s": F.col("w"), "k": F.lit(1)}).collect():
        before = [y for y in rows if y[0] == x.g and (y[1], y[2]) < (x.v, x.i)]
        assert x.k == len(before) and abs(x.s - sum(y[3] for y in before)) < 1e-9
    q = {x.g: x for x in rk.quantiles(df, ["g"], "v", {"m": 0.5, "h": 0.95}).collect()}
    for g in ("a", "b", None):
        own = [y[1] for y in rows if y[0] == g]
        assert q[g].n == len(own) and np.allclose([q[g].m, q[g].h], np.percentile(own, [50, 95]))
    assert sorted(x.place for x in rk.numbered(df, ["i"]).collect()) == list(range(300))


def test_fits_are_the_least_losses(spark):
    r = np.random.default_rng(1)
    z = r.normal(size=(1500, 3))
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    y = np.eye(3)[[r.choice(3, p=q) for q in p]]
    gap = r.normal(size=1500) * 2
    share = (r.uniform(size=1500) < 1 / (1 + np.exp(-(2 * gap - 1.5)))).astype(float)
    rows = [("c", "choice", [float(v) for v in 3 * a], [float(v) for v in b]) for a, b in zip(z, y, strict=True)]
    for name, s in (("n", share), ("m", 1 - share)):
        rows += [(name, "noul", [float(g), 0.0], [float(v), 1 - float(v)]) for g, v in zip(gap, s, strict=True)]
    found = {x.g: x for x in cal.fit(spark.createDataFrame(rows, "g string, kind string, logits array<double>, target array<double>"), ["g"]).collect()}
    assert abs(found["c"].temperature - plain.best_temperature(3 * z, y)) < 1e-4 and found["c"].a is None and found["c"].n == 1500
    a, b = plain.best_platt(gap, share)
    assert abs(found["n"].a - a) < 1e-5 and abs(found["n"].b - b) < 1e-5 and abs(a - 2) < 0.3
    mean = float((1 - share).mean())
    assert found["m"].a == 0.0 and abs(found["m"].b - np.log(mean / (1 - mean))) < 1e-9


def test_label_rules(spark):
    df = spark.createDataFrame([(0.125, 1, [0, 0]), (0.375, 5, [2, 0]), (0.625, 7, [1, 0]), (1.0, 9, [0, 1])], "s double, r int, c array<long>")
    rows = df.select(lb.ordinal_bucket(F.col("s")).alias("b"), lb.rating_level(F.col("r")).alias("l"), lb.group_state(F.col("c")).alias("g"), lb.banded_answer(F.col("s")).alias("a")).collect()
    assert [tuple(r) for r in rows] == [(0, 0, False, "yes"), (2, 3, True, "yes"), (2, 4, None, None), (4, None, None, "no")]
    r = spark.createDataFrame([(["a", "NaN", "b"], 2, ["x", " x ", "y"], "x")], "o array<string>, g int, m array<string>, a string").select(lb.without_padding(F.col("o"), F.col("g")).alias("w"), lb.matched_once(F.col("m"), F.col("a")).alias("m")).first()
    assert (r.w.options, r.w.gold, r.m) == (["a", "b"], 1, False)
    with pytest.raises(Exception, match="not a label"):
        spark.createDataFrame([("0.5",)], "c string").select(lb.tri_state_flag(F.col("c"))).collect()
    assert [x[0] for x in spark.createDataFrame([("1",), ("0.0",)], "c string").select(lb.tri_state_flag(F.col("c"))).collect()] == [True, False]


def test_boxes(spark):
    b = spark.createDataFrame([("i", 0.0, 0.0, 0.5, 0.5, False, False, 100, 100), ("i", 0.0, 0.0, 0.9, 0.9, False, False, 100, 100), ("i", 0.1, 0.0, 0.9, 0.9, False, False, 100, 100), ("i", 0.0, 0.0, 0.1, 0.9, False, False, 100, 100)], "image_id string, x0 double, y0 double, x1 double, y1 double, is_group boolean, is_depiction boolean, w int, h int")
    assert lb.face_boxes(b).count() == 2
    r = spark.range(1).select(lb.context_box(F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0), F.lit(100.0)).alias("b")).first().b
    assert tuple(r) == (0.0, 0.0, 37.0, 42.0)


def test_boxes_alike_go_by_number(spark):
    box = spark.range(20, 0, -1, 3).select(F.lit("i").alias("image_id"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 0.5), ("y1", 0.5), ("is_group", False), ("is_depiction", False), ("w", 200), ("h", 200))], F.col("id").alias("box"))
    assert sorted(r.box for r in lb.face_boxes(box, ties=("box",)).collect()) == [1, 2]


def test_weighted_samples_follow_weights(spark):
    df = spark.range(3000).select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in (("a", 6.0), ("b", 3.0), ("c", 1.0))])).alias("x")).select("id", "x.n", "x.w")
    first = df.groupBy("id").agg(F.min_by("n", sm.weighted_order(F.col("w"), 0, "t", F.col("id"), F.col("n"))).alias("n")).groupBy("n").count().collect()
    share = {r.n: r["count"] / 3000 for r in first}
    assert abs(share["a"] - 0.6) < 0.03 and abs(share["c"] - 0.1) < 0.02


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = [r.id for r in sm.sample(df, 20, 1, "id").collect()]
    assert a == [r.id for r in sm.sample(df.repartition(7), 20, 1, "id").collect()]
    assert {r["count"] for r in sm.sample_per_group(df.withColumn("g", F.col("id") % 3), 5, 0, "id", ["g"]).groupBy("g").count().collect()} == {5}


def test_packing_invariants(spark):
    r = random.Random(0)
    rows = [(i, k, r.randint(1, 200) if (i, k) != (0, 0) else 500) for i in range(20) for k in range(r.randint(1, 9))]
    found = pk.pack(spark.createDataFrame(rows, "image long, ord long, length int")).collect()
    groups = {}
    for x in sorted(found, key=lambda x: (x.image, x.ord)):
        groups.setdefault((x.image, x.seq), []).append(x)
    assert len(found) == len(rows)
    for own in groups.values():
        assert len(own) <= 4 and (len(own) == 1 or sum(x.length for x in own) <= 320)
        at = 0
        for x in own:
            assert x.offset == at
            at += x.length


def test_visibility(spark):
    rows = [(0, 0, 0, -1), (0, 1, 1, -1), (0, 2, 1, 0), (0, 3, 1, 1), (0, 4, 2, -1), (0, 5, -1, -1)]
    sees = {}
    for r in pk.visible(spark.createDataFrame(rows, "seq int, pos int, block int, cand int")).collect():
        sees.setdefault(r.pos, set()).add(r.sees)
    assert sees == {0: {0}, 1: {0, 1, 2, 3}, 2: {0, 1, 2}, 3: {0, 1, 3}, 4: {0, 4}, 5: {5}}


def test_window_counts_are_the_pairs(spark):
    lengths = [0, 1, 2, 3, 4, 5, 6, 9, 40]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    places = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i)
    pairs = df.withColumn("a", F.explode(places)).withColumn("b", F.explode(places)).where("a < n and b < n").where(pk.within_window(F.col("a") - F.col("b"), 8)).groupBy("n").count()
    assert {r.n: r["count"] for r in pairs.collect()} | {0: 0} == {r.n: r.s for r in df.select("n", pk.seen_in_window(F.col("n"), 8).alias("s")).collect()}


@pytest.mark.parametrize("capacity", [1, 8, 64])
def test_cache_is_an_ordered_dict(spark, capacity):
    r = random.Random(capacity)
    keys = [r.randint(0, 120) if r.random() < 0.7 else r.randint(0, 5) for _ in range(1500)]
    held, want = OrderedDict(), []
    for k in keys:
        want.append(k in held)
        held[k] = None
        held.move_to_end(k)
        if len(held) > capacity:
            held.popitem(last=False)
    log = spark.createDataFrame([(3 * i - 100, k or None, "x") for i, k in enumerate(keys)], "ord long, key long, i string").repartition(5)
    # Blocks of 16 places: most pairs are counted above them.
    for bits in (4, 14):
        found = ru.cache_hits(log, capacity=capacity, block_bits=bits)
        assert [x.hit for x in found.orderBy("ord").collect()] == want
    curve = {r.capacity: r.hits for r in ru.hit_curve(ru.reuse_distances(log, block_bits=6), []).collect()}
    assert curve[max((c for c in curve if c <= capacity), default=0)] == sum(want)
    assert ru.cache_hits(log.limit(0)).count() == 0 and [r.hit for r in ru.cache_hits(log.limit(1)).collect()] == [False]


def test_requests(spark):
    rows = [("choice", "q", ["a", "b"], None), ("choice", "q", ["a"], "options"), ("score", "q", ["a"] * 11, "levels"), ("noul", " ", None, "text"), ("x", "q", None, "kind"), ("noul", "q", None, None), ("choice", "q", ["a"] * 256, "options")]
    df = spark.createDataFrame(rows, "k string, t string, o array<string>, want string")
    assert all(r.want == r.got for r in df.select("want", sv.question_problem(F.col("k"), F.col("t"), F.col("o")).alias("got")).collect())
    r = spark.createDataFrame([("data:image/png;base64,AAEC",), ("AAEC",), ("!!",)], "d string").select(sv.decodable(F.col("d")).alias("b")).collect()
    assert [x.b for x in r] == [bytearray(b"\0\1\2"), bytearray(b"\0\1\2"), None]
    a = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "request int, ord int, answer string")
    assert sv.assembled(a).first().answers == ["a", "b"]


def test_scorers_and_metrics_by_name(spark):
    sv.register_scorer("length", lambda batch: [[len(q), 0.0] for q in batch["question"]])
    assert sv.score(spark.createDataFrame([("abc",)], "question string"), "length").first().logits == [3.0, 0.0]
    mt.register_metric("spread", lambda g: g["v"].max() - g["v"].min())
    assert mt.measure(spark.createDataFrame([("a", 1.0), ("a", 4.0)], "g string, v double"), ["g"], "spread").first().spread == 3.0


def test_cost_fit_recovers(spark):
    rows = [(float(a), float(b), 0.5 + 0.2 * a + 0.1 * b) for a, b in zip([2, 4, 8, 12, 22, 2, 8, 22], [1, 3, 2, 9, 5, 7, 11, 13], strict=True)]
    r = rp.cost_fit(spark.createDataFrame(rows, "l double, g double, ms double"), "l", "g", "ms").first()
    assert np.allclose([r.c, r.a, r.b, r.r2, r.mape], [0.5, 0.2, 0.1, 1, 0], atol=1e-9)


def test_split_fallback_and_probe(spark):
    x = spark.createDataFrame([("a", "calib"), ("a", "report"), ("b", "calib")], "g string, split string")
    assert sorted(tuple(r) for r in rp.report_items(x, ["g"]).collect()) == [("a", "report"), ("b", "calib")]
    r = np.random.default_rng(0)
    rows = [([float(v) for v in r.normal(size=6) + (i % 2)], i % 2, i % 3 == 0, i % 5 == 0) for i in range(300)]
    got = rp.linear_probe(spark.createDataFrame(rows, "f array<double>, y int, t boolean, inner boolean"), "f", "y", test="t").first()
    assert got.auroc > 0.9 and got.n == 100
