"""Holds a query's rows against its SQL in DuckDB."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def database(sf_dir=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    return [plain(v) for v in x] if isinstance(x, list | tuple) else x


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want
