"""Every registered query of the library itself against its SQL, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from glyphsieve.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def same(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in registry.oracle_sql():
        assert got
        return
    sql = registry.oracle_sql()[name]
    assert sorted(db.sql(sql).columns) == columns
    expected = sorted(db.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall(), key=repr)
    assert len(got) == len(expected) and all(same(a, b) for x, y in zip(got, expected) for a, b in zip(x, y))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["pattern_index", "pattern", "table", "hits"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
