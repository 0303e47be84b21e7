import pytest

from tabulon.plans import catalogue

from .compare import SF, assert_same, database


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    assert_same(catalogue.PLANS[name](spark, SF), con, catalogue.SQL[name])


def test_every_query_without_sql_has_a_value_test():
    from . import test_values

    assert set(catalogue.PLANS) - set(catalogue.SQL) == {n.removeprefix("test_") for n in vars(test_values) if n.startswith("test_")}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = {}
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows[n] = [sorted(map(str, catalogue.PLANS[q](spark, SF).collect())) for q in ("scorer_report", "weighted_distractors", "lru_cache_hits", "pack_sequences")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows["1"] == rows["9"]
