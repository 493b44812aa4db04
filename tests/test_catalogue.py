"""Each query against the SQL that expresses it, on the same tables."""

import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from lorewell.plans.everything import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    sql = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    key = lambda r: repr(r)
    mine = sorted(rows(df.columns, [tuple(r) for r in df.collect()]), key=key)
    theirs = sorted(rows(sql.columns, sql.fetchall()), key=key)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_operators(tmp_path):
    """The rest works where that subpackage and the pipeline are gone."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "lorewell"), tmp_path / "lorewell", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recall_hybrid' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    here = os.path.dirname(importlib.import_module("lorewell").__file__)
    for folder, _, names in os.walk(here):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "lorewell.llm" not in open(os.path.join(folder, n)).read(), n
