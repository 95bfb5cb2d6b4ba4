"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from compare import norm
from tallyloom import queries as core


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.Q))
def test_query(spark, data, con, name):
    df = core.Q[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in core.SQL:
        assert len(set(cols)) == len(cols)
        return
    rel = con.execute(core.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_know_llm():
    root = os.path.dirname(os.path.abspath(core.__file__))
    for p in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            assert "tallyloom.llm" not in open(p).read(), p
