import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import intervals
from tabulon.sources import ranges


def test_overlaps(spark):
    r = random.Random(1)
    mine = [(i, r.choice(["a", "b"]), a := r.randrange(200), a + r.choice([0, 1, 7, 90])) for i in range(60)] + [(60, None, 1, 5), (61, "a", None, 5)]
    theirs = [(i, r.choice(["a", "a", "b"]), a := r.randrange(-20, 200), a + r.choice([0, 1, 3, 150])) for i in range(60)] + [(60, None, 1, 5)]
    want = sorted((x[0], y[0]) for x in mine for y in theirs if None not in (x[1], x[2]) and x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3]))
    a, b = spark.createDataFrame(mine, "x int, k string, start long, stop long"), spark.createDataFrame(theirs, "y int, k string, low long, high long")
    for width in (None, 1, 13, 10_000):
        assert sorted((p.x, p.y) for p in intervals.overlaps(a, b, ["k"], width=width).collect()) == want
    assert intervals.overlaps(a.limit(0), b, ["k"]).count() == intervals.overlaps(a, b.limit(0), ["k"]).count() == 0


def test_last_start(spark):
    points = spark.createDataFrame([(1, "a", -5), (2, "a", 0), (3, "a", 99), (4, "a", 100), (5, "a", 10**12), (6, "b", 7), (7, "a", None), (8, "c", 3)], "i int, k string, at long")
    starts = spark.createDataFrame([("a", 0), ("a", 0), ("a", 100), ("a", 101), ("b", 8), ("b", None)], "k string, start long")
    assert sorted((r.i, r.start) for r in intervals.last_not_beyond(points, starts, ["k"]).collect()) == [(2, 0), (3, 0), (4, 100), (5, 101)]


def put(folder, name, data):
    (folder / name).write_bytes(data)


def test_ranges_of_split_archives(spark, tmp_path):
    whole = bytes(random.Random(2).randbytes(1000))
    cuts = [0, 1, 400, 400, 650, 1000]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        put(tmp_path, f"x.{i}", whole[a:b])
    put(tmp_path, "y.0", b"other")
    files = ranges.file_sizes(spark, str(tmp_path)).withColumn("blob", F.regexp_extract("path", r"([^/]+)\.\d+$", 1))
    archive = ranges.parts(files, blob="blob")
    asked = [(0, "x", 0, -1), (1, "x", 0, 1), (2, "x", 399, 2), (3, "x", 1, 700), (4, "x", 990, 50), (5, "x", 3, 0), (6, "y", 1, 3), (7, "x", 5000, 3), (8, "none", 0, 3), (9, "x", 0, -1)]
    got = {r.id: bytes(r.data) for r in ranges.read_ranges(spark.createDataFrame(asked, "id int, blob string, offset long, length long"), archive).collect()}
    want = {i: {"x": whole, "y": b"other"}.get(b, b"")[o : None if n < 0 else o + n] for i, b, o, n in asked}
    assert got == want
    found = ranges.pieces(spark.createDataFrame(asked, "id int, blob string, offset long, length long"), archive).where("id = 3").count()
    assert found == 3


def test_offsets_beyond_two_gigabytes_and_short_files(spark, tmp_path):
    at = 5 * 2**30
    with open(tmp_path / "big", "wb") as f:
        f.seek(at)
        f.write(b"far away")
    archive = ranges.parts(ranges.file_sizes(spark, str(tmp_path / "big")))
    asked = spark.createDataFrame([(1, "", at, 3), (2, "", at + 4, -1), (3, "", at - 2, 3)], "id int, blob string, offset long, length long")
    assert {r.id: bytes(r.data) for r in ranges.read_ranges(asked, archive).collect()} == {1: b"far", 2: b"away", 3: b"\0\0f"}
    gone = spark.createDataFrame([(str(tmp_path / "big"), at, 100)], "path string, offset long, length long")
    with pytest.raises(Exception, match="were asked for"):
        ranges.read_pieces(gone).collect()


@pytest.mark.parametrize("split", [1, 100, 1 << 20])
def test_chunks(spark, tmp_path, split):
    put(tmp_path, "a", bytes(range(250)))
    put(tmp_path, "b", b"")
    put(tmp_path, "_SUCCESS", b"x")
    rows = sorted((r.path, r.offset, bytes(r.data)) for r in ranges.blob_chunks(spark, str(tmp_path), chunk=100, split=split).collect())
    assert [(o, len(d)) for _, o, d in rows] == [(0, 100), (100, 100), (200, 50)] and b"".join(d for *_, d in rows) == bytes(range(250))
