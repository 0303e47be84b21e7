import json
import threading

import pytest

from tabulon.sources import commits
from tabulon.sources.commits import Commits, Conflict


def numbers(table):
    return sorted(r.id for r in table.read().collect())


def test_rows_count_once_they_are_in_the_log(spark, tmp_path, monkeypatch):
    t = Commits(spark, str(tmp_path / "t"), key=["id"])
    assert t.read() is None and t.rows() == 0 and t.version() == 0
    assert t.append(spark.range(3)) == 1
    with monkeypatch.context() as m:
        m.setattr(commits, "_create", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            t.append(spark.range(100, 200))
    # The run that failed has left files, but no rows.
    assert len(list((tmp_path / "t/data").iterdir())) == 2 and numbers(t) == [0, 1, 2] and t.rows() == 3
    assert t.append(spark.range(7, 9)) == 2 and numbers(t) == [0, 1, 2, 7, 8]
    assert t.replace(spark.range(1)) == 3 and numbers(t) == [0] and t.rows() == 1
    assert t.append(spark.range(0)) == 4 and t.rows() == 1
    entry = json.loads((tmp_path / "t/log/00000000000000000001.json").read_text())
    assert entry["rows"] == 3 and entry["kind"] == "append"


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    Commits(spark, path, key=["id"]).append(spark.range(2))
    failed = []

    def write(f):
        try:
            f(Commits(spark, path, key=["id"]))
        except Exception as e:
            failed.append(e)

    def together(*work):
        threads = [threading.Thread(target=write, args=(f,)) for f in work]
        [t.start() for t in threads]
        [t.join() for t in threads]

    together(*[lambda t, i=i: t.append(spark.range(10 * i, 10 * i + 2)) for i in (1, 2, 3)])
    assert numbers(Commits(spark, path)) == [0, 1, 10, 11, 20, 21, 30, 31] and Commits(spark, path).version() == 4
    # The same rows by two writers are there once.
    together(*[lambda t: t.append_missing(spark.range(40, 45))] * 3)
    assert numbers(Commits(spark, path))[-5:] == [40, 41, 42, 43, 44] and Commits(spark, path).rows() == 13 and not failed
    base = Commits(spark, path).version()
    together(*[lambda t, i=i: t.replace(spark.range(i), base=base) for i in (3, 4)])
    assert len(failed) == 1 and isinstance(failed[0], Conflict) and Commits(spark, path).rows() in (3, 4)
