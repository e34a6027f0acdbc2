"""The registered queries over the smallest tables: against their SQL, or their shape and whole tables."""

import glob
import importlib
import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sparksieve.llm.registry import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    cell = lambda v: None if v is None or v != v else float(f"{v:.9g}") if isinstance(v, float) and not math.isinf(v) else v
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = duck.execute(SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    assert plain(tuple(r[c] for c in columns) for r in frame.collect()) == plain(tuple(row[order.index(c)] for c in columns) for row in found.fetchall())


WHOLE = {"op1": "documents", "op2": "documents", "op3": "documents", "op6": "documents", "op9": "documents"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows(spark, duck, name):
    rows = QUERIES[name](spark, DATA).collect()
    number = name.split("_")[0]
    if number in WHOLE:
        ids = [r[0] for r in duck.execute(f"SELECT doc_id FROM {WHOLE[number]}").fetchall()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if number == "op10":
        assert len(rows) == 2 * duck.execute("SELECT count(*) FROM pages").fetchone()[0]
    if number == "op7":
        assert len(rows) == duck.execute("SELECT count(*) + count(*) FILTER (vec_id % 10 = 0) FROM embeddings").fetchone()[0]
    assert rows


def test_entry_without_this_package(monkeypatch):
    """The entry module imports, and has the other queries, where this package and the pipeline are gone."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name == "sparksieve.llm" or name.startswith("sparksieve.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    kept = {k: v for k, v in sys.modules.items() if k == "corpus_pipeline" or k.startswith("sparksieve.llm")}
    for k in kept:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    try:
        importlib.reload(entry)
        assert "filter_counters" in entry.queries() and not [n for n in entry.queries() if n.startswith(("op", "pipeline"))]
    finally:
        monkeypatch.undo()
        sys.modules.update(kept)
        importlib.reload(entry)
    assert "pipeline" in entry.queries()
