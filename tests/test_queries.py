"""Every query of the reference's operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skein import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from read_parquet('{t}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE:
        want = con.execute(catalogue.ORACLE[name]).fetchdf()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got, want))
        assert a.equals(b)


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("skein.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "skein.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.import_module("__spark_entry__")
    assert "edge_flow" in e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
    monkeypatch.delitem(sys.modules, "__spark_entry__")
