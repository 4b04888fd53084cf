"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from blockloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck, sf_dir):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_registry_is_complete():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_entry_imports():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
