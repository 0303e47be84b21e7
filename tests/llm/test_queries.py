import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import queries as q

from ..compare import SF, assert_same, database
from .helpers import alnum, fold, rows_of
from .test_dedup import plain_decontamination, plain_jaccard


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, name):
    assert_same(q.queries()[name](spark, SF), database(), q.SQL[name])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_one_row_per_row_and_remote_reads(spark, name):
    if name.startswith(("op3_", "op11_", "op12_", "op13_")):
        return
    table = "pages" if name.startswith("op6_") else "documents"
    assert q.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark, tmp_path):
    """Each stage equals its plain version, on what the stage before it kept."""
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/documents.parquet").columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in rows_of(docs)}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert sorted(docs.columns) == sorted(columns)
            kept = {r["doc_id"] for r in rows_of(docs)}
        if name == "language ID":
            assert kept == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact dedup":
            best = {}
            for i, t in before.items():
                best[fold(t)] = max(i, best.get(fold(t), i))
            assert kept == set(best.values())
        elif name == "n-gram Jaccard join":
            assert kept == {i for i, (_, c) in plain_jaccard(list(before.items())).items() if c == i}
        elif name == "benchmark decontamination":
            assert kept == {i for i, v in plain_decontamination([(i, t) for i, t in before.items() if len(alnum(t)) < 4000], items).items() if not v[4]} | {i for i in kept if len(alnum(before[i])) >= 4000}
        else:
            assert {r["doc_id"] for r in rows_of(docs)} == set(before) and docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_tables_without_rows(spark, tmp_path):
    for name in ("documents", "benchmark", "pages", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in q.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
    shutil.rmtree(tmp_path)
