"""Each query that has SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from recollect.plans.all import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        db.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in SQL:
        found = duck.sql(SQL[name])
        place = {c: i for i, c in enumerate(found.columns)}
        assert sorted(place) == columns
        assert plain(got) == plain([tuple(r[place[c]] for c in columns) for r in found.fetchall()])
    else:
        assert got
