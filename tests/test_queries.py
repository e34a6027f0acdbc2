"""Each query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from sparksieve.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    cell = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) and not math.isinf(v) else v
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = duck.execute(SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    want = [tuple(row[order.index(c)] for c in columns) for row in found.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in frame.collect()) == plain(want)
