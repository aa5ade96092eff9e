"""Every registered query runs; every one with SQL equals DuckDB."""

from __future__ import annotations

import uuid

import pytest
from oracle import TESTDATA, compare, connect

from skein.plans.fixtures import StoredFixtures
from skein.plans.registry import load_all
from skein.session import shared_dir
from skein.sources.tablestore import TableStore

SF_DIR = f"{TESTDATA}/sf0.001"
CATALOG = load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def tables(spark):
    """The tables as the library stores them; the raw views feed the build."""
    store = TableStore(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    return StoredFixtures.build(spark, SF_DIR, store)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_equals_duckdb(tables, duck, name):
    q = CATALOG[name]
    equal, note = compare(q.run(tables), duck, q.sql)
    assert equal, note


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if not q.sql])
def test_runs(tables, name):
    df = CATALOG[name].run(tables)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)


def test_names_are_plain():
    assert all(n.replace("_", "").isalnum() for n in CATALOG)
