"""Every registered query with an SQL equivalent against DuckDB over the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from docweave import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = plans.load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0:.9g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in ORACLE:
        assert df.count() > 0
        return
    cur = db.execute(ORACLE[name])
    want_names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(want_names)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want_names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
