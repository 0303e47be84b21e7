"""Stages of the pipeline on rows whose ids repeat or lack: each row goes by its own text."""

import pytest

from tabulon.llm import decontaminate, exact, jaccard, langid

from .helpers import rows_of, table


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in rows_of(df)), key=str)


def same(rows):
    return sorted(rows, key=str)


def test_exact_stage_keeps_one_row_per_text(spark, monkeypatch):
    monkeypatch.setattr(exact, "FOLD_BYTES", 1)
    rows = [(4, "Same"), (4, "Same"), (4, "Same"), (None, "same"), (None, "other"), (None, "Other two"), (None, "other two"), (7, "a"), (7, "b"), (9, "B"), (-3, "neg"), (5, None), (5, "")]
    found = left(exact.drop_exact(table(spark, rows)))
    assert len(found) == 7
    assert [r for r in found if (r[1] or "").lower() not in ("other two", "")] == same([(4, "Same"), (None, "other"), (7, "a"), (9, "B"), (-3, "neg")])
    assert [i for i, t in found if (t or "").lower() in ("other two", "")] in ([5, None], [None, 5])
    assert exact.drop_exact(table(spark, rows)).columns == table(spark, []).columns


def test_near_stage_goes_by_rows(spark):
    words = [f"k{i}" for i in range(60)]
    long, near = " ".join(words), " ".join(words[1:])
    rows = [(3, long), (2, near), (2, "a text of its own under the same id"), (None, " ".join(words[:-1])), (None, "nothing like the others at all"), (None, None), (None, ""), (8, ""), (8, "")]
    want = [(2, near), (2, "a text of its own under the same id"), (None, "nothing like the others at all"), (None, None), (None, ""), (8, ""), (8, "")]
    assert left(jaccard.drop_near(table(spark, rows))) == same(want)
    assert left(jaccard.drop_near(table(spark, [(3, long), (3, near), (None, long), (None, long)]))) in ([(3, long)], [(3, near)])
    assert left(jaccard.drop_near(table(spark, [(None, long), (None, long)]))) == [(None, long)]


@pytest.mark.parametrize("limit", [32 << 20, 10])
def test_decontamination_stage_goes_by_rows(spark, limit):
    items = spark.createDataFrame([(1, "secret phrase here"), (2, "one more of them")], "item_id long, text string")
    rows = [(None, "the Secret, phrase here"), (None, "clean"), (1, "one more of them"), (1, "also clean"), (2, None)]
    assert left(decontaminate.without_benchmark(table(spark, rows), items, set_bytes=limit)) == same([(None, "clean"), (1, "also clean"), (2, None)])


def test_language_stage_goes_by_rows(spark):
    rows = [(i, f"some words of number {i}") for i in range(20)] + [(None, "words without an id"), (None, "123 %%"), (1, "456"), (1, None)]
    assert left(langid.drop_unidentified(table(spark, rows))) == same([r for r in rows if r[1] and r[1][0].isalpha()])
