"""Every registered query of the library runs, and agrees with its SQL on DuckDB where it has one."""

import os

import duckdb
import pytest

from coppice.plans import catalog

FOLDER = os.environ.get("COPPICE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    out = catalog.queries()[name](spark, FOLDER)
    columns = sorted(out.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in out.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())


def test_entry_survives_without_the_llm_folder(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def gone(name, *rest):
        if name.startswith("coppice.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name=name)
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(entry.queries()) == set(catalog.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitioning_does_not_matter(spark):
    """Row order and partition count change no result."""
    from coppice.operators import mining as M

    rows = [(k % 17, f"t{k * 7 % 11}") for k in range(300)]
    seen = set()
    for n in (1, 7, 32):
        df = spark.createDataFrame(rows, "site int, token string").repartition(n)
        out = M.pair_weights(M.sites(df, ["site"], "token")).collect()
        seen.add(tuple(sorted((r.a, r.b, r.weight) for r in out)))
    assert len(seen) == 1
