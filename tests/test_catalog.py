"""Every query of the catalogue against its SQL on the small tables, and the driver's entry points."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from attesta import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_all_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())


def test_nothing_else_imports_the_corpus_operators():
    root = Path(catalog.__file__).parent
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] != "llm":
            assert "llm" not in p.read_text()


def test_small_tables_are_read_in_the_driver_folder():
    assert (DATA / "sf0.001").exists()
