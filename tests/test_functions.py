import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import hashing as hs
from tabulon.functions import probability as pr
from tabulon.functions import strings as st


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_splits_are_those_of_the_digest(spark):
    ids = [f"coco:{i}" for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    rows = df.select("id", hs.calibration_split(F.col("id")).alias("s"), hs.in_calibration(F.concat("id", F.lit("#face0"))).alias("c"), hs.in_development(F.col("id")).alias("d"), hs.digest_mod10(F.col("id")).alias("m")).collect()
    number = lambda t: int(hashlib.sha1(t.encode()).hexdigest()[:8], 16)
    for r in rows:
        assert r.s == ("calib" if number(r.id) / 0xFFFFFFFF < 0.2 else "report")
        assert r.c == (number("calib:" + r.id) % 20 == 0)
        assert r.d == (number("dev:" + r.id) / 0xFFFFFFFF < 0.02)
        assert r.m == int(hashlib.sha1(r.id.encode()).hexdigest(), 16) % 10


def test_hash_bits(spark):
    v = [float(x) for x in np.random.default_rng(0).normal(size=64)]
    want = sum(1 << (63 - i) for i in range(64) if v[i] > v[(i + 1) % 64])
    got = one(spark, hs.adjacent_bits(F.array(*map(F.lit, v))).alias("b"), hs.unsigned_text_to_bits(F.lit(str(want))).alias("u"), hs.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long")).alias("h"))
    assert got.b & (2**64 - 1) == want and got.u == got.b and got.h == 64


def test_scores(spark):
    p, y, even = arr(0.8, 0.2), arr(1, 0), arr(0.5, 0.5)
    r = one(spark, pr.brier(p, y).alias("a"), pr.nll(p, y).alias("b"), pr.brier(even, arr(0, 1)).alias("c"), pr.correctness(p, y).alias("d"), pr.correctness(even, arr(0, 1)).alias("e"), pr.majority(even).alias("f"), pr.first_max(even).alias("g"))
    assert math.isclose(r.a, 0.08) and math.isclose(r.b, -math.log(0.8)) and r.c == 0.5 and (r.d, r.e, r.f, r.g) == (1.0, 0.0, None, 0)


def test_ranked_score_penalises_distance(spark):
    y = arr(1, 0, 0, 0, 0)
    r = one(spark, pr.ranked_probability_score(arr(0, 1, 0, 0, 0), y).alias("near"), pr.ranked_probability_score(arr(0, 0, 0, 0, 1), y).alias("far"), pr.proper_loss(arr(0.5, 0.5), arr(0.5, 0.5), F.lit("choice")).alias("l"))
    assert (r.near, r.far) == (1.0, 4.0) and math.isclose(r.l, 0.3 * math.log(2))


def test_softmax_platt_and_friends(spark):
    r = one(spark, pr.softmax(arr(2, 0, -1), 2.0).alias("s"), pr.platt(arr(1, 0), F.lit(2.0), F.lit(-1.5)).alias("p"), pr.log_sum_exp(arr(1000, 1000)).alias("l"), pr.expected_level(arr(0, 0.5, 0.5)).alias("e"), pr.padded(arr(1), 3, float("-inf")).alias("k"), pr.one_hot(F.lit(1), F.lit(3)).alias("o"), pr.soft_level(F.lit(0)).alias("q"))
    want = np.exp(np.array([1, 0, -0.5]))
    assert np.allclose(r.s, want / want.sum()) and math.isclose(r.p[0], 1 / (1 + math.exp(-0.5))) and math.isclose(r.l, 1000 + math.log(2))
    assert r.e == 1.5 and r.k == [1.0, float("-inf"), float("-inf")] and r.o == [0.0, 1.0, 0.0] and np.allclose(r.q, [0.7 / 0.85, 0.15 / 0.85, 0, 0, 0])


def test_rotations_undo_order(spark):
    base = [3.0, 1.0, 2.0]
    shown = [[base[(i + r) % 3] + 10 * i for i in range(3)] for r in range(3)]
    got = one(spark, pr.rotation_average(F.array(*[arr(*s) for s in shown])).alias("a")).a
    assert np.allclose(got, [x + 10 for x in base])


@pytest.mark.parametrize(("k", "n"), [(0, 0), (65, 119), (5, 5)])
def test_wilson(spark, k, n):
    low, high = pr.wilson(F.lit(k), F.lit(n))
    r = one(spark, low.alias("low"), high.alias("high"))
    if not n:
        assert math.isnan(r.low) and math.isnan(r.high)
    else:
        p, z = k / n, 1.96
        half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        assert math.isclose(r.low, (p + z * z / 2 / n - half) / (1 + z * z / n), abs_tol=1e-12) and math.isclose(r.high, (p + z * z / 2 / n + half) / (1 + z * z / n), abs_tol=1e-12)


def test_text_rules(spark):
    rows = [("Is it a cat or a dog?", "cat", "dog"), ("Is the cup red or blue?", "red", "blue"), ("Is it red or the blue one?", "blue", "red"), ("Is it a bus?", "bus", None), ("Tea or coffee or milk?", "milk", "coffee")]
    df = spark.createDataFrame(rows, "q string, a string, want string")
    assert all(r.want == r.got for r in df.select("want", st.named_alternative(F.col("q"), F.col("a")).alias("got")).collect())
    urls = spark.createDataFrame([("http://x/65535/123_ab_c.jpg", "123"), ("https://www.x.com/photos/me/456/", "456"), ("https://x.com/photos/me/789", "789")], "u string, want string")
    assert all(r.want == r.got for r in urls.select("want", st.photo_id(F.col("u")).alias("got")).collect())
    r = one(spark, st.word_edit_distance(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("x"))).alias("d"), st.singular(F.lit("glasses")).alias("s"), st.article(F.lit("apple")).alias("a"), st.first_listed(F.lit("x-sdxl-flux"), ["flux", "sdxl"]).alias("g"), st.tokens(F.lit("Don't stop-it 5")).alias("t"))
    assert (r.d, r.s, r.a, r.g, r.t) == (2, "glasse", "an", "flux", ["don't", "stop-it"])


def test_option_layouts(spark):
    cases = [
        ("What?\nOptions: A: one, two, B: three\nC: four", ("What?", ["one, two", "three", "four"])),
        ("What is it?\nOptions: A: a cat, on a mat., B: two dogs, C: 3, 4, and 5, D: None", ("What is it?", ["a cat, on a mat.", "two dogs", "3, 4, and 5", "None"])),
        ("q Options: A: x, C: y, B: z", ("q", ["x, C: y", "z"])),
        ("Hint: a letter\nQuestion: Which?\nChoices:\n(A) x\n(B) y", ("Which?", ["x", "y"])),
        ("no options", None), ("q Options: A: only", None), ("Question: q\nChoices:\n(A) x\n(C) y", None), (None, None),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string").select("i", st.parse_options(F.col("q")).alias("o"))
    assert all((r.o and (r.o.stem, r.o.options)) == cases[r.i][1] for r in df.collect())


def test_named_alternative_among_known_answers(spark):
    known = F.array(*map(F.lit, ("blue", "white", "train", "giraffe", "horse")))
    rows = [("Is it a giraffe or a horse?", "horse", "giraffe"), ("Is that a train or a bus?", "bus", "train"), ("Is the pizza to the left or to the right of the table the pizza is on?", "left", None), ("Is that a bus or a train?", "train", None)]
    df = spark.createDataFrame(rows, "q string, a string, want string")
    assert all(r.want == r.got for r in df.select("want", st.named_alternative(F.col("q"), F.col("a"), known).alias("got")).collect())


def test_clashes(spark):
    rows = [("dogs", "dog", True), ("Grey ", "gray", True), ("lady", "woman", True), ("woman", "lady", True), ("cat", "dog", False), ("glass", "gla", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", st.clashes(F.col("a"), F.col("b")).alias("got")).collect())


def test_edit_distances_of_word_lists():
    import random

    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))

    r = random.Random(0)
    pairs = [([r.choice("abc") for _ in range(r.randint(0, 5))], [r.choice("abc") for _ in range(r.randint(0, 5))]) for _ in range(60)]
    assert st.edit_distances(*map(list, zip(*pairs, strict=True))).tolist() == [plain(a, b) for a, b in pairs]


def test_state_and_board(spark):
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    r = one(spark, st.with_state(F.lit(" s "), F.lit("q")).alias("a"), st.with_state(F.lit(None).cast("string"), F.lit("q")).alias("b"), st.json_text(a=F.lit(1), b=F.lit('x"y'), c=F.lit(None).cast("int")).alias("j"), st.board_rows(3, 2, at(0, 0), at(2, 1), F.array(at(0, 0), at(1, 0))).alias("g"), st.candidate_text(F.lit("k"), F.lit("v")).alias("k"))
    assert (r.a, r.b, r.j, r.g, r.k) == ("s\nq", "q", '{"a": 1, "b": "x\\"y", "c": null}', "Ho.\n..F", "k: v")
