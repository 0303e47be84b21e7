import io
import json
import tarfile
import zipfile
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tabulon.sources import files, schemas, sinks
from tabulon.sources.commits import Commits
from tabulon.streaming import rolling


def test_decisions_are_validated(spark):
    rows = [("choice", ["a", "b"], [0.5, 0.5], None), ("choice", ["a"], [1.0], "options"), ("noul", ["a", "b"], [0.5, 0.4], "mass"), ("what", ["a", "b"], [1.0, 0.0], "kind"), ("score", ["a", " a"], [1.0, 0.0], "candidates"), ("score", ["a", "b"], [1.0], "length"), (None, None, None, "kind")]
    df = schemas.validated(spark.createDataFrame(rows, "kind string, candidates array<string>, target array<double>, want string"))
    assert all(r.problem == r.want for r in df.collect())


def test_readers(spark, tmp_path):
    (tmp_path / "m1__bench.jsonl").write_text('{"uid": "a", "k": 2}\n{"uid": "b", "k": 3}\n')
    r = files.run_files(spark, str(tmp_path / "*.jsonl"), "uid string, k int").orderBy("uid").collect()
    assert [tuple(x) for x in r] == [("a", 2, "m1", "bench"), ("b", 3, "m1", "bench")]
    (tmp_path / "x.tsv").write_text('id\ttext\n1\t"a\nb"\n2\t' + "z" * 200_000 + "\n")
    rows = files.delimited(spark, str(tmp_path / "x.tsv"), "id int, text string", "\t").orderBy("id").collect()
    assert rows[0].text == "a\nb" and len(rows[1].text) == 200_000
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("q/one.json", json.dumps([{"a": 1}, {"a": 2}]))
        z.writestr("skip.txt", "x")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        raw = json.dumps({"a": 3}).encode()
        info = tarfile.TarInfo("two.json")
        info.size = len(raw)
        t.addfile(info, io.BytesIO(raw))
    got = files.archived_json(spark, str(tmp_path / "*.{zip,tar}")).select(F.from_json("value", "a int")["a"].alias("a")).collect()
    assert sorted(x.a for x in got) == [1, 2, 3]
    assert files.load(spark, "jsonl", str(tmp_path / "m1__bench.jsonl"), schema="uid string").count() == 2


def test_run_names(spark):
    r = spark.createDataFrame([("C5_ep2_lrA_s0_labels",), ("C1b_1e+15_lrC_s1",)], "n string").select(files.run_name(F.col("n")).alias("r")).collect()
    assert (r[0].r.cand, r[0].r.seed, r[0].r.sanity, r[1].r.sanity) == ("C5", "0", "labels", None)


def test_sinks_resume_and_reuse(spark, tmp_path):
    path, todo = str(tmp_path / "out"), spark.range(10).withColumn("v", F.array(F.col("id").cast("double")))
    sinks.append_missing(todo.where("id < 4"), path, ["id"])
    assert not sinks.is_complete(todo, path)
    sinks.append_missing(todo, path, ["id"])
    sinks.append_missing(todo, path, ["id"])
    assert Commits(spark, path).read().count() == 10 and sinks.is_complete(todo, path) and sinks.is_complete(10, path, spark)
    sinks.write_split(todo, str(tmp_path / "s"), F.when(F.col("id") < 3, "calib").otherwise("report"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'calib'").count() == 3
    cache = str(tmp_path / "cache")
    sinks.reuse_or_write(todo, cache, "id", "v")
    moved = todo.withColumn("v", F.array(F.col("id") + 5.0))
    assert sinks.reuse_or_write(todo, cache, "id", "v").agg(F.sum(F.get("v", F.lit(0)))).first()[0] == 45.0
    assert sinks.reuse_or_write(moved, cache, "id", "v").agg(F.sum(F.get("v", F.lit(0)))).first()[0] == 95.0
    assert "| — |" in sinks.markdown(spark.createDataFrame([("a", None)], "n string, x double"))


@pytest.fixture
def events(spark, tmp_path):
    path = str(tmp_path / "events")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for part in range(3):
        e.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    return path


def drained(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.table(name)


def test_stream_windows_equal_the_batch(spark, events):
    batch = rolling.rolling_latency(spark.read.parquet(events), window="1 day", slide="1 day")
    stream = drained(spark, rolling.rolling_latency(rolling.read_events(spark, events), window="1 day", slide="1 day", late="400 days"), "lat", "update")
    last = stream.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    assert {tuple(r) for r in last.collect()} == {(r.start, r.event_type, r.n) for r in batch.collect()}


def test_stream_cache_state(spark, events):
    e = rolling.read_events(spark, events, files_per_trigger=10).withColumn("server", F.col("user_id") % 2)
    got = drained(spark, rolling.streaming_cache_hits(e, server="server", key="event_type", capacity=2), "lru", "append")
    hits = {r.event_id: r.hit for r in got.collect()}
    for s in (0, 1):
        held = OrderedDict()
        for r in spark.read.parquet(events).where(F.col("user_id") % 2 == s).orderBy("event_id").collect():
            assert hits[r.event_id] == (r.event_type in held)
            held[r.event_type] = None
            held.move_to_end(r.event_type)
            if len(held) > 2:
                held.popitem(last=False)


def test_model_headers(spark, tmp_path):
    import json

    header = json.dumps({"__metadata__": {"format": "pt"}, "a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b": {"dtype": "F16", "shape": [3], "data_offsets": [8, 14]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + bytes(14))
    (r,) = files.tensor_sizes(files.model_headers(spark, str(tmp_path)), "header").collect()
    assert (r.parts, r.bytes) == (2, 14)
