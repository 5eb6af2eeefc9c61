"""The operators' queries against their SQL, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from glyphsieve.llm import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr) and got


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in found
