"""Queries held against their SQL on small tables with odd rows."""

import pytest

from tabulon.plans import catalogue

from .compare import assert_same, database


@pytest.fixture
def same(spark, tmp_path):
    """Holds a query against its SQL over one table of the rows given."""

    def hold(query, table, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(tmp_path / f"{table}.parquet")
        df = catalogue.PLANS[query](spark, str(tmp_path))
        assert_same(df, database(tmp_path), catalogue.SQL[query])
        return df

    return hold


def test_windowed_mask_makes_no_tokens(same):
    rows = [(1, 0, "a b c"), (1, 0, "d e f g h i j k l m"), (1, -1, "x"), (2, 3, None), (2, 4, ""), (3, 1, "w " * 500)]
    df = same("windowed_mask", "conversations", rows, "conv_id long, turn long, text string")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_question_phrasing_of_odd_texts(same):
    texts = ["x two\nlines y", "x a\r\n b", "one", "", None, "two  spaces", "The girls play", "A Woman waits", "x what? now", "he\nshe us", " cat", "x in\tthis\tphoto z", "x \n y", "x \u0130he y", "x an y", "x any y"]
    same("question_phrasing", "benchmark", [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_presence_questions_draw_once(same):
    rows = [(i // 3, i * 7 % 25 * (-1 if i % 11 == 0 else 1)) for i in range(900)] + [(7, None), (None, 3), (None, None), (7, 7)]
    df = same("presence_questions", "lineitem", [r for r in rows if r[1] is not None], "l_orderkey long, l_partkey long")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("0|no") + plan.count("|, 0, no") <= 1 and "Join LeftSemi" not in plan
